"""Lists, tables and constants that decide results."""

# --- fixed values: request limits -------------------------------------------
MAX_QUERY_LENGTH = 500
MAX_FILTER_LENGTH = 200
MAX_URL_LENGTH = 2000
MAX_STRING_LENGTH = 500
MAX_PAGE = 1000
MAX_PER_PAGE = 100
DEFAULT_PER_PAGE = 20
VALID_DATA_TYPES = ["article", "person", "business", "place", "media", "event", "product"]
VALID_SCHEMAS = [
    "Article", "BlogPosting", "NewsArticle", "HowTo", "Recipe", "WebPage", "FAQPage", "Product",
    "Service", "LocalBusiness", "Person", "Organization", "Event", "VideoObject", "ImageGallery",
    "AudioObject", "Book", "Movie", "MusicRecording",
]

# --- fixed values: cities and states ----------------------------------------
DEFAULT_CITY = "Atlanta"
SUPPORTED_CITIES = [
    "Atlanta", "Houston", "Chicago", "Detroit", "New York", "Los Angeles", "Philadelphia",
    "Washington", "Baltimore", "Charlotte", "Memphis", "New Orleans", "Oakland", "Miami",
    "Dallas", "St. Louis",
]
CITY_ALIASES = {
    "nyc": "New York", "ny": "New York", "la": "Los Angeles", "dc": "Washington",
    "washington dc": "Washington", "washington d.c.": "Washington", "philly": "Philadelphia",
    "nola": "New Orleans", "chi": "Chicago", "atl": "Atlanta", "htx": "Houston",
}
US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA",
    "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA",
    "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT",
    "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
    "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
    "district of columbia": "DC",
}

# --- fixed values: stop lists -----------------------------------------------
MATCH_STOPWORDS = [
    "a", "an", "the", "and", "or", "of", "in", "on", "at", "to", "for", "by", "with", "from", "as",
    "is", "are", "was", "were", "be", "been", "it", "its", "that", "this", "these", "those", "not", "no",
]
SIGNAL_STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from",
    "as", "is", "was", "are", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "shall", "can", "need", "when", "where", "who",
    "what", "which", "why", "how", "that", "this", "these", "those", "it", "its", "he", "she", "they",
    "we", "you", "i", "his", "her", "their", "our", "your", "my", "about", "into", "through", "during",
    "before", "after", "above", "below", "between", "each", "than", "so", "if", "not", "no", "nor",
    "yet", "both", "either", "just", "also", "then", "such", "more", "most", "other", "born", "died",
    "first", "last", "new", "old", "many", "much", "long", "little", "own", "right", "big", "high",
    "great", "small",
]

# --- fixed values: filler phrases dropped before a text is embedded -----------
FILLER_PATTERNS = [
    r"\b(i am |i'm |i want to |i need to |can you |please |help me )\b",
    r"\b(looking for |find me |search for |show me |tell me about )\b",
    r"\b(what is |who is |where is |how to |how do i |how can i )\b",
    r"\b(could you |would you |i would like |do you know |do you have )\b",
    r"\b(the best |a good |some good |any good |really good |very good )\b",
    r"\b(basically |actually |just |really |very |quite |pretty )\b",
    r"\b(i think |i believe |i guess |maybe |perhaps |probably )\b",
    r"\b(kind of |sort of |type of |lots of |a lot of )\b",
]
MAX_EMBED_WORDS = 40

# --- fixed values: temporal patterns ----------------------------------------
YEAR = r"(1[89]\d{2}|20[0-2]\d)"
TEMPORAL_PATTERNS = {
    "year": r"\b(1[89]\d{2}|20[0-2]\d)\b",
    "decade": r"\b(1[89]\d{2}|20[0-2]\d)s\b",
    "year_range": r"\b(1[89]\d{2}|20[0-2]\d)\s*[-–—to]+\s*(1[89]\d{2}|20[0-2]\d)\b",
    "century": r"(?i)\b(\d{1,2})(st|nd|rd|th)\s+century\b",
    "relative": r"\b(last|past|recent|previous|next)\s+(year|decade|century|month|week)\b",
    "era": r"\b(pre-war|post-war|antebellum|reconstruction|civil\s+rights\s+era|jazz\s+age|harlem\s+renaissance)\b",
}

# --- fixed values: user agents, addresses, web handles -------------------------
BOT_MARKERS = ["bot", "crawler", "spider", "scraper", "curl", "wget"]
PRIVATE_IP_PREFIXES = [
    "127.", "10.", "192.168.", "172.16.", "172.17.", "172.18.", "172.19.", "172.20.", "172.21.",
    "172.22.", "172.23.", "172.24.", "172.25.", "172.26.", "172.27.", "172.28.", "172.29.", "172.30.",
    "172.31.", "169.254.", "::1", "fe80:",
]
UNKNOWN_COUNTRY_CODES = ["XX", "T1"]
WEB_HANDLE_PATTERNS = [
    r"^(https?://)?(www\.)([\w\-]+\.)+[\w\-]+(/[\w\-?=&%#.]*)*/?$",
    r"^@[\w._\-]+$",
    r"^(https?://)?(www\.)?(facebook|fb|twitter|instagram|linkedin|youtube|tiktok|pinterest|reddit|snapchat|fiverr)\.com/?",
    r"^(https?://)?([\w\-]+\.)?(shopify|myshopify)\.com/?",
]

# --- fixed values: vocabulary categories --------------------------------------
NGRAM_NAMES = {1: "unigram", 2: "bigram", 3: "trigram", 4: "quadgram"}
LOCATION_CATEGORIES = [
    "us_city", "us city", "city", "us_state", "us state", "state", "location", "region", "country",
    "neighborhood", "continent",
]
