"""Fixed values of the browse pages."""

# --- fixed values: business sub-categories and the words they search -----------
SUBCATEGORIES = {
    "restaurants": ["restaurant", "food", "dining", "catering", "cafe"],
    "beauty": ["salon", "barber", "beauty", "hair", "nails", "spa"],
    "professional": ["lawyer", "accountant", "consultant", "financial", "insurance"],
    "contractors": ["contractor", "plumber", "electrician", "construction", "handyman"],
    "realestate": ["real estate", "realtor", "property", "mortgage", "housing"],
    "retail": ["retail", "store", "shop", "boutique", "clothing"],
    "creative": ["photography", "design", "art", "music", "media", "marketing"],
    "tech": ["technology", "software", "web", "app", "IT", "digital"],
}

# --- fixed values: culture topics -------------------------------------------------
# topic -> (schemas, category)
CULTURE_TOPICS = {
    "hbcus": ([], "hbcu"),
    "film": (["culture", "media"], None),
    "music": (["culture"], "music"),
    "art": (["culture"], "art"),
    "literature": (["culture"], "literature"),
    "food": (["culture"], "food"),
    "fashion": (["culture"], "fashion"),
    "history": (["culture"], "history"),
    "theater": (["culture"], "theater"),
    "events": (["culture"], "events"),
}

# --- fixed values: community help categories and side lists -------------------------
HELP_CATEGORIES = {
    "housing": "housing", "legal": "legal", "jobs": "employment", "food": "food", "family": "family",
    "youth": "youth", "faith": "faith", "nonprofit": "nonprofit", "social_justice": "social_justice",
}
COMMUNITY_LISTS = {  # name -> (words, newest first, rows)
    "events": (["event", "meeting", "workshop", "conference"], True, 5),
    "churches": (["church", "baptist", "ame", "methodist", "faith", "ministry"], False, 8),
    "organizations": (["naacp", "urban", "league", "organization", "nonprofit", "foundation"], False, 4),
    "volunteering": (["volunteer", "service", "help", "mentor", "tutor"], True, 5),
}
