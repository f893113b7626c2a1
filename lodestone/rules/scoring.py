"""Fixed values of scoring, blending, facets and overview text."""

# --- fixed values: blend ratios per query mode (text, semantic, authority) -----
BLEND_RATIOS = {
    "answer": (0.25, 0.60, 0.15),
    "explore": (0.30, 0.50, 0.20),
    "browse": (0.40, 0.35, 0.25),
    "local": (0.30, 0.30, 0.40),
    "compare": (0.30, 0.50, 0.20),
    "shop": (0.35, 0.30, 0.35),
}
ANSWER_SINGLE_BLEND = (0.65, 0.25, 0.10)
LIVE_AUTHORITY = 0.05
AUTHORITY_SAMPLE = 20

# --- fixed values: document types per mode -----------------------------------
POOL_PRIMARY = {"local": "business", "shop": "product"}
POOL_ALLOW = {
    "local": ["business", "place"],
    "shop": ["product", "business"],
    "answer": ["article", "person", "place"],
    "browse": ["article", "business", "product"],
    "explore": ["article", "person", "media"],
    "compare": ["article", "person", "business"],
}
PREFERRED_TYPES = {
    "answer": ["article", "person", "place"],
    "explore": ["article", "person", "media"],
    "browse": ["article", "business", "product"],
    "local": ["business", "place", "article"],
    "shop": ["product", "business", "article"],
    "compare": ["article", "person", "business"],
}

# --- fixed values: domain and intent alignment ---------------------------------
DOMAIN_CATEGORIES = {
    "food": ["food_recipes", "dining", "lifestyle"],
    "business": ["business", "finance", "entrepreneurship"],
    "health": ["healthcare_medical", "wellness", "fitness"],
    "music": ["entertainment", "music", "culture"],
    "fashion": ["fashion", "beauty", "lifestyle"],
    "education": ["education", "hbcu", "scholarship"],
    "travel": ["travel_tourism", "lifestyle"],
    "real_estate": ["real_estate", "business"],
    "sports": ["sports", "entertainment"],
    "technology": ["technology", "business"],
    "beauty": ["beauty", "lifestyle", "fashion"],
    "culture": ["culture", "news", "lifestyle"],
}
DOMAIN_SERVICES = {
    "food": ["restaurant", "cafe", "bakery", "catering", "food", "dining", "eatery", "diner", "buffet",
             "bar", "brewery", "winery", "food truck", "coffee"],
    "beauty": ["salon", "barbershop", "spa", "nail salon", "hair salon", "nail tech", "esthetician",
               "lash studio", "brow bar"],
    "health": ["clinic", "doctor", "dentist", "gym", "fitness", "pharmacy", "urgent care", "therapist",
               "chiropractor", "optometrist", "mental health"],
    "education": ["school", "tutoring", "daycare", "academy", "preschool", "childcare", "learning center"],
    "real_estate": ["realty", "realtor", "property management", "real estate", "mortgage", "home inspection"],
    "technology": ["software", "it services", "tech support", "web design", "app development"],
    "business": ["consulting", "accounting", "legal", "staffing", "financial", "insurance", "marketing",
                 "advertising"],
    "culture": ["museum", "gallery", "cultural center", "community center", "church", "nonprofit"],
    "music": ["studio", "recording studio", "music venue", "club", "lounge", "concert venue"],
    "fashion": ["boutique", "clothing store", "tailor", "alterations", "fashion", "apparel"],
    "sports": ["gym", "fitness center", "sports facility", "yoga", "martial arts", "dance studio"],
}
INTENT_CONTENT = {
    "local": ["transactional", "navigational"],
    "shop": ["transactional", "commercial"],
    "answer": ["informational", "educational"],
    "browse": ["informational", "commercial", "transactional"],
    "explore": ["informational", "educational"],
    "compare": ["informational", "commercial"],
}
QUESTION_SUBJECT_TYPES = {
    "who": ["PERSON"],
    "where": ["PLACE", "LANDMARK"],
    "when": ["EVENT"],
    "what": ["CONCEPT", "WORK", "PRODUCT"],
    "which": ["CONCEPT", "WORK", "PRODUCT"],
}

# --- fixed values: gates, boosts and weights -------------------------------------
SEMANTIC_GATE = 0.65
QUESTION_GATE = 0.40
REVIEW_SCALE = {"business": 500, "product": 500, "recipe": 200}
OWNED_BOOST = 0.12
PREFERRED_TYPE_BOOST = 0.08
SUPERLATIVE_CAP = 0.70
SUBJECT_HIGH, SUBJECT_MEDIUM, SUBJECT_LOW = 1.60, 1.30, 1.10
SUBJECT_SECONDARY = 1.15
SUBJECT_MENTION_ONLY = 0.70
SUBJECT_TYPE_BOOST = 1.20
FIELD_WEIGHTS = {
    "document_title": 1.00, "entity_names": 0.90, "primary_keywords": 0.75, "key_facts": 0.60,
    "topic_tags": 0.35, "semantic_keywords": 0.40, "document_summary": 0.25,
}
RICHNESS_WEIGHTS = {
    "content_depth_score": 0.35, "factual_density_score": 0.30, "concept_count": 0.20,
    "subtopic_richness": 0.10, "word_count": 0.05,
}
AUTHORITY_WEIGHTS = {
    "authority_rank_score": 0.35, "factual_density_score": 0.25, "content_depth_score": 0.20,
    "subtopic_richness": 0.10, "evergreen_score": 0.10,
}
CEILINGS = {
    "authority_rank_score": 100.0, "factual_density_score": 100.0, "content_depth_score": 100.0,
    "evergreen_score": 100.0, "subtopic_richness": 50.0, "concept_count": 50.0, "word_count": 3000.0,
}
THIN_RICHNESS = 0.30
MIXED_FIELDS = ["primary_keywords", "entity_names", "document_title", "key_facts", "semantic_keywords", "topic_tags"]
DISTANCE_LIMITS = {
    "answer": 0.60, "explore": 0.70, "compare": 0.65, "browse": 0.85, "local": 0.85, "shop": 0.80,
}
DEFAULT_DISTANCE_LIMIT = 0.75
NEUTRAL_TEXT_FLOOR = 0.08

# --- fixed values: weights of the searched fields ------------------------------
SEARCH_FIELD_WEIGHTS = {
    "primary_subject_name": 100, "document_title": 10, "entity_names": 8, "primary_keywords": 6,
    "secondary_subjects": 5, "key_facts": 4, "semantic_keywords": 3,
}

# --- fixed values: display labels ------------------------------------------------
DATA_TYPE_LABELS = {
    "article": "Articles", "person": "People", "business": "Businesses", "place": "Places",
    "media": "Media", "event": "Events", "product": "Products",
}
CATEGORY_LABELS = {
    "healthcare_medical": "Healthcare", "fashion": "Fashion", "beauty": "Beauty",
    "food_recipes": "Food & Recipes", "travel_tourism": "Travel", "entertainment": "Entertainment",
    "business": "Business", "education": "Education", "technology": "Technology", "sports": "Sports",
    "finance": "Finance", "real_estate": "Real Estate", "lifestyle": "Lifestyle", "news": "News",
    "culture": "Culture", "general": "General",
}
DISPLAY_GROUPS = {
    "article": "articles", "content": "articles", "video": "videos", "media": "videos",
    "product": "products", "person": "people", "place": "places", "location": "places", "service": "services",
}

# --- fixed values: overview text ---------------------------------------------------
OVERVIEW_STOPWORDS = [
    "who", "what", "where", "when", "why", "how", "is", "are", "the", "a", "an", "in", "of", "for", "to",
    "do", "does", "can", "was", "were", "be", "been", "it", "its", "this", "that",
]
FACT_WORDS = {
    "where": ["located", "bounded", "continent", "region", "coast", "ocean", "border", "north", "south",
              "east", "west", "latitude", "longitude", "hemisphere", "capital", "city", "state", "country",
              "area", "lies", "situated"],
    "when": ["founded", "established", "born", "created", "started", "opened", "built", "year", "date",
             "century", "decade", "era", "period"],
    "who": ["first", "president", "founder", "ceo", "leader", "director", "known", "famous", "awarded",
            "pioneer", "invented", "created", "named", "appointed", "elected"],
    "what": ["is a", "refers to", "defined", "known as", "type of", "form of", "means", "represents"],
}
QUESTION_STARTS = ["who", "what", "where", "when", "why", "how", "is", "are", "can", "do", "does"]
QUESTION_INTROS = ["Based on our sources,", "According to our data,", "From what we know,",
                   "Our sources indicate that"]
PLAIN_INTROS = ["Here's what we know:", "From our sources:", "Based on our data:", "Our sources show that"]
FEATURED_AUTHORITY = 85
