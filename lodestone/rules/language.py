"""Fixed values of query understanding: stop words, grammar, correction."""

# --- fixed values: stop words and their part of speech ---------------------------
STOPWORDS = [
    "a", "an", "the", "in", "on", "at", "to", "for", "of", "and", "or", "but", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "must", "can", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we",
    "they", "what", "which", "who", "whom", "where", "when", "why", "how", "all", "each", "every", "both",
    "few", "more", "most", "other", "some", "such", "no", "not", "only", "own", "same", "so", "than", "too",
    "very", "just", "also", "now", "here", "there", "then", "from", "by", "into", "through", "during",
    "before", "after", "me", "my", "your", "his", "her", "its", "our", "their",
]
POS_WORDS = {
    "determiner": ["a", "an", "the", "this", "that", "these", "those", "some", "any", "each", "every", "all",
                   "both", "no", "few", "more", "most", "other", "such", "my", "your", "his", "its", "our",
                   "their", "own"],
    "preposition": ["in", "on", "at", "to", "for", "of", "from", "by", "with", "into", "through", "during",
                    "before", "after", "about", "between", "under", "above", "below"],
    "conjunction": ["and", "or", "but", "so", "than"],
    "pronoun": ["i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "what", "which",
                "who", "whom"],
    "be": ["is", "are", "was", "were", "be", "been", "being", "am"],
    "auxiliary": ["have", "has", "had", "do", "does", "did"],
    "modal": ["will", "would", "could", "should", "may", "might", "must", "can"],
    "adverb": ["where", "when", "why", "how", "here", "there", "then", "now", "too", "very", "just", "also",
               "only", "not", "same", "once"],
}

# --- fixed values: first prediction of each grammar context ----------------------
# (left, right) -> (part of speech, confidence); None = neighbour not known
CONTEXT_RULES = {
    ("determiner", "noun"): ("adjective", 0.95), ("determiner", "adjective"): ("adjective", 0.85),
    ("determiner", "verb"): ("noun", 0.90), ("determiner", "preposition"): ("noun", 0.90),
    ("article", "noun"): ("adjective", 0.95), ("article", "verb"): ("noun", 0.90),
    ("article", "preposition"): ("noun", 0.90), ("adjective", "noun"): ("adjective", 0.85),
    ("adjective", "verb"): ("noun", 0.90), ("adjective", "preposition"): ("noun", 0.90),
    ("noun", "noun"): ("verb", 0.85), ("noun", "adjective"): ("verb", 0.90), ("noun", "adverb"): ("verb", 0.90),
    ("noun", "preposition"): ("verb", 0.85), ("verb", "noun"): ("adjective", 0.80),
    ("verb", "adjective"): ("adverb", 0.85), ("verb", "preposition"): ("noun", 0.85),
    ("preposition", "noun"): ("adjective", 0.85), ("preposition", "verb"): ("noun", 0.85),
    ("preposition", "preposition"): ("noun", 0.80), ("preposition", "end"): ("noun", 0.90),
    ("pronoun", "noun"): ("verb", 0.90), ("pronoun", "adjective"): ("verb", 0.90),
    ("pronoun", "preposition"): ("verb", 0.90), ("be", "noun"): ("adjective", 0.85),
    ("be", "adjective"): ("adverb", 0.90), ("be", "preposition"): ("noun", 0.85),
    ("determiner", None): ("noun", 0.85), ("article", None): ("noun", 0.85), ("adjective", None): ("noun", 0.90),
    ("pronoun", None): ("verb", 0.90), ("verb", None): ("noun", 0.75), ("preposition", None): ("noun", 0.85),
    ("noun", None): ("verb", 0.80), ("adverb", None): ("adjective", 0.80), ("be", None): ("adjective", 0.85),
    (None, "noun"): ("adjective", 0.90), (None, "verb"): ("noun", 0.85), (None, "adjective"): ("adverb", 0.85),
    (None, "adverb"): ("verb", 0.80), (None, "preposition"): ("noun", 0.85), (None, "determiner"): ("verb", 0.85),
    (None, "proper_noun"): ("preposition", 0.80),
}
DEFAULT_POS = ("noun", 0.5)

# --- fixed values: parts of speech that stand in for each other -------------------
POS_GROUPS = {
    "noun": ["noun", "proper_noun"], "proper_noun": ["proper_noun", "noun"],
    "verb": ["verb", "participle", "gerund"], "participle": ["participle", "verb", "adjective"],
    "gerund": ["gerund", "verb", "noun"], "adjective": ["adjective", "participle"], "adverb": ["adverb"],
    "pronoun": ["pronoun", "relative_pronoun", "wh_pronoun"], "relative_pronoun": ["relative_pronoun", "pronoun"],
    "wh_pronoun": ["wh_pronoun", "pronoun"], "determiner": ["determiner", "article"],
    "article": ["article", "determiner"], "preposition": ["preposition"], "conjunction": ["conjunction"],
    "interjection": ["interjection"], "be": ["be", "verb", "auxiliary"],
    "auxiliary": ["auxiliary", "verb", "modal"], "modal": ["modal", "auxiliary", "verb"],
}

# --- fixed values: correction weights and keyboard neighbours ----------------------
W_DISTANCE, W_KEYBOARD, W_POS_MATCH, W_POS_NEAR = 100, 30, 80, 50
W_BIGRAM, W_TRIGRAM, W_FREQUENCY, POS_PENALTY = 120, 150, 0.01, -10
MAX_DISTANCE, MAX_PAIR_DISTANCE = 2, 4
KEY_NEIGHBOURS = {
    "q": ["w", "a", "s"],
    "w": ["q", "e", "a", "s", "d"],
    "e": ["w", "r", "s", "d", "f"],
    "r": ["e", "t", "d", "f", "g"],
    "t": ["r", "y", "f", "g", "h"],
    "y": ["t", "u", "g", "h", "j"],
    "u": ["y", "i", "h", "j", "k"],
    "i": ["u", "o", "j", "k", "l"],
    "o": ["i", "p", "k", "l"],
    "p": ["o", "l"],
    "a": ["q", "w", "s", "z", "x"],
    "s": ["q", "w", "e", "a", "d", "z", "x", "c"],
    "d": ["w", "e", "r", "s", "f", "x", "c", "v"],
    "f": ["e", "r", "t", "d", "g", "c", "v", "b"],
    "g": ["r", "t", "y", "f", "h", "v", "b", "n"],
    "h": ["t", "y", "u", "g", "j", "b", "n", "m"],
    "j": ["y", "u", "i", "h", "k", "n", "m"],
    "k": ["u", "i", "o", "j", "l", "m"],
    "l": ["i", "o", "p", "k"],
    "z": ["a", "s", "x"],
    "x": ["a", "s", "d", "z", "c"],
    "c": ["s", "d", "f", "x", "v"],
    "v": ["d", "f", "g", "c", "b"],
    "b": ["f", "g", "h", "v", "n"],
    "n": ["g", "h", "j", "b", "m"],
    "m": ["h", "j", "k", "n"],
}
TYPO_NEIGHBOURS = {
    "q": "wa", "w": "qeas", "e": "wrds", "r": "etdf", "t": "ryfg", "y": "tugh", "u": "yihj", "i": "uojk",
    "o": "ipkl", "p": "ol", "a": "qwsz", "s": "awedxz", "d": "serfcx", "f": "drtgvc", "g": "ftyhbv",
    "h": "gyujnb", "j": "huikmn", "k": "jiolm", "l": "kop", "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb",
    "b": "vghn", "n": "bhjm", "m": "njk",
}
MAX_TYPO_CANDIDATES = 100

# --- fixed values: filters, sorts and category flags ---------------------------------
TEMPORAL_SORT = {  # word -> (field, order)
    "first": ("time_period_start", "asc"), "oldest": ("time_period_start", "asc"),
    "earliest": ("time_period_start", "asc"), "last": ("time_period_start", "desc"),
    "latest": ("published_date", "desc"), "recent": ("published_date", "desc"), "newest": ("published_date", "desc"),
}
KEYWORD_CATEGORIES = ["education", "culture", "business", "sports", "music", "art", "history", "food", "fashion",
                      "health", "technology", "religion", "politics"]
ENTITY_CATEGORIES = ["person", "organization"]
SUMMARY_CATEGORIES = {  # flag -> categories that raise it
    "has_person": ["person", "name"],
    "has_location": ["city", "us city", "us_city", "state", "us state", "us_state", "country", "location",
                     "region", "neighborhood", "continent"],
    "has_topic": ["culture", "keyword", "education", "health", "politics", "history", "religion", "concept",
                  "community", "historical event", "food"],
    "has_song_title": ["song title", "song", "album"],
    "has_media": ["song title", "song", "music", "media", "entertainment", "tv show", "movie", "album", "book"],
    "has_food": ["food"],
    "has_business": ["business", "organization"],
    "has_culture": ["culture"],
    "has_entity": ["person", "name", "business", "organization"],
}
UNSAFE_CATEGORIES = ["Food", "US City", "US State", "Country", "Location", "City", "Place", "Object", "Animal",
                     "Color", "Person", "Organization", "Brand"]
INTERROGATIVES = ["who", "what", "when", "where", "why", "which", "whose", "how", "is", "are", "was", "were", "do",
                  "does", "did", "can", "could", "should", "will", "would"]
MAX_RANK = 10_000_000
US_STATE_ABBREV = {
    "georgia": "GA", "florida": "FL", "texas": "TX", "california": "CA", "new york": "NY", "alabama": "AL",
    "louisiana": "LA", "mississippi": "MS", "tennessee": "TN", "north carolina": "NC", "south carolina": "SC",
    "virginia": "VA", "maryland": "MD", "ohio": "OH", "pennsylvania": "PA", "michigan": "MI", "illinois": "IL",
    "missouri": "MO", "arkansas": "AR", "oklahoma": "OK", "kentucky": "KY", "west virginia": "WV", "delaware": "DE",
    "washington": "WA", "oregon": "OR", "colorado": "CO", "arizona": "AZ", "nevada": "NV", "utah": "UT",
    "new mexico": "NM", "massachusetts": "MA", "connecticut": "CT", "new jersey": "NJ",
    "district of columbia": "DC", "washington dc": "DC",
}
