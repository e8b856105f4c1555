"""Word lists, lookup tables, patterns, formats and defaults that results depend on."""

# ---------------------------------------------------------------- entities
ENTITY_TYPES = ("country", "city", "landmark")
PROVENANCE = (
    "wikidata", "geonames", "geonames_alternate", "geonames_fallback",
    "whosonfirst", "natural_earth", "machine_translation", "missing",
)
DEFAULT_SOURCE = "wikidata"
SOURCE_NAME_PATTERN = r"^[a-z][a-z0-9_]{0,63}\z"
QID_PATTERN = r"^[Qq][1-9][0-9]*\z"
NAMESPACED_ID_PATTERN = r"^[a-z][a-z0-9_-]{1,31}:[A-Za-z0-9][A-Za-z0-9_.:-]{0,159}\z"
SOURCE_PRIORITY = ("wikidata", "geonames", "natural_earth")
REPLACEABLE_NAME_PROVENANCE = ("geonames", "geonames_fallback", "missing")
EXPLICIT_VI_PROVENANCE = ("geonames", "geonames_alternate")

# ---------------------------------------------------------------- gazetteer files
CONTINENT_BY_CODE = {
    "AF": "Africa", "AN": "Antarctica", "AS": "Asia", "EU": "Europe",
    "NA": "North America", "OC": "Oceania", "SA": "South America",
}
CONTINENTS = ("Africa", "Antarctica", "Asia", "Europe", "North America", "Oceania", "South America")
CAPITAL_FEATURE_CODE = "PPLC"
REPLACEMENT_CHARACTER = "\ufffd"
CITY_COLUMNS = (
    "geoname_id", "name", "ascii_name", "alternate_names", "latitude", "longitude", "feature_class",
    "feature_code", "country_code", "alternate_country_codes", "admin1_code", "admin2_code",
    "admin3_code", "admin4_code", "population", "elevation", "dem", "timezone", "modification_date",
)
COUNTRY_COLUMNS = (
    "iso2", "iso3", "iso_numeric", "fips", "country_name", "capital", "area_km2", "population",
    "continent_code", "tld", "currency_code", "currency_name", "phone", "postal_code_format",
    "postal_code_regex", "languages", "geoname_id", "neighbours", "equivalent_fips_code",
)
COUNTRY_MIN_COLUMNS = 17
ADMIN1_COLUMNS = ("code", "name", "ascii_name", "geoname_id")
ALTERNATE_NAME_COLUMNS = (
    "alternate_name_id", "geoname_id", "language", "name", "preferred", "short_name",
    "colloquial", "historic", "valid_from", "valid_to",
)
NAME_LANGUAGES = ("en", "vi")
LEGACY_LETTERS = "Ðð"
LEGACY_REPLACEMENTS = "Đđ"
CONCORDANCE_PLACETYPES = {"city": ("locality",), "country": ("country", "dependency")}
CONCORDANCE_LANGUAGES = {"en": "eng", "vi": "vie"}
CONCORDANCE_ID_PATTERN = r'"(?:gn:id|gn:geonameid)"\s*:\s*(\[[^\]]*\]|"[0-9]+"|[0-9]+)'
COVERAGE_MIN_CITIES = 5000
COVERAGE_REQUIRED_CONTINENTS = ("North America", "South America")
SAMPLE_LIMIT = 100
PUBLIC_SOURCES = ("geonames", "wof")
BACKBONE_TYPES = ("country", "city")
MANIFEST_VERSION = 6
QUALITY_POLICY = "geonames_fail_fast_wof_best_effort"

# ---------------------------------------------------------------- text folding and query understanding
QUOTE_CHARACTERS = "“”‘’'\"`"
JS_SPACE = (
    "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

CONTINENT_ALIASES = (
    ("South America", ("south america", "south american", "nam my", "chau nam my")),
    ("North America", ("north america", "north american", "bac my", "chau bac my")),
    ("Europe", ("europe", "european", "chau au")),
    ("Africa", ("africa", "african", "chau phi")),
    ("Asia", ("asia", "asian", "chau a")),
)
# On folded text.
COUNTRY_INTENT_PATTERNS = (
    r"\bwhich\s+(?:[a-z]+\s+){0,5}(?:country|nation)\b",
    r"\bwhat\s+(?:[a-z]+\s+){0,5}(?:country|nation)\b",
    r"^(?:country|nation)\b",
    r"\bquoc gia\s+(?:[a-z0-9]+\s+){0,6}nao\b",
    r"\bnuoc\s+nao\b",
    r"^quoc gia\b",
)
# (text the pattern runs on, pattern with one group); {S} stands for one Unicode space class.
CAPITAL_PATTERNS = (
    ("original", r"(?i)(?<![A-Za-z0-9_])(?:has|have){S}+(.+?){S}+as{S}+(?:its|the){S}+(?:national{S}+)?capital(?![A-Za-z0-9_])"),
    ("original", r"(?i)(?:c[óÓ]|co){S}+(.+?){S}+(?:l[àÀ]m|lam){S}+(?:th[ủỦ]|thu){S}+(?:[đĐ][ôÔ]|do)"),
    ("folded", r"\bco\s+(.+?)\s+lam\s+thu\s+do(?:\s+quoc\s+gia)?\b"),
    ("original", r"(?i)(?:c[óÓ]|co){S}+th[ủỦ]{S}+[đĐ][ôÔ]{S}+(.+?)(?:{S}+v[àÀ]{S}+|{S}+va{S}+|[?,;]|\z)"),
    ("folded", r"\bcapital\s+is\s+(.+?)(?:\s+and\b|[?,;]|\z)"),
)
CAPITAL_TRAILING_PUNCTUATION = r"[?.,;:]+\z"
CAPITAL_CONJUNCTION_TAIL = r"(?i){S}+(?:and|va|v[àÀ]){S}+.*\z"
CAPITAL_PHRASE_TAIL = r"(?i){S}+(?:as{S}+its{S}+capital|lam{S}+thu{S}+do(?:{S}+quoc{S}+gia)?)\z"
CAPITAL_FOLDED_TAIL = r"\bva\b.*\z"
CAPITAL_SIMILARITY_FLOOR = 0.70

GEOGRAPHIC_QUESTION_PATTERNS = (
    r"\bwhere\b",
    r"\blocated\b",
    r"\bwhich\s+(?:[a-z0-9]+\s+){0,2}(?:city|country|nation)\b",
    r"\bwhat\s+(?:city|country|nation)\b",
    r"\b(?:city|country|nation)\b.*\b(?:population|capital|continent|region|located)\b",
    r"\b(?:thanh pho|quoc gia|nuoc)\b",
    r"\bo dau\b",
)
MEDIA_MARKER = r"\b(?:movie|film|phim)\b"
MEDIA_CONTENT = r"\b(?:plot|story|storyline|noi dung|cot truyen|noi ve)\b"
CLUB_MARKER = r"\b(?:football club|soccer club|cau lac bo bong da)\b"
CLUB_ACHIEVEMENT = r"\b(?:trophy|trophies|title|titles|won|win|danh hieu|gianh|vo dich)\b"
MEDIA_INTENT = ("media-work", "media-content-intent")
CLUB_INTENT = ("sports-club", "sports-club-achievement-intent")
GEOGRAPHIC_TYPES = ("city", "country")
REASON_TYPE = "entity-type-mismatch"
REASON_CONTINENT = "continent-mismatch"
REASON_CAPITAL = "capital-mismatch"
REASON_INTENT = "geographic-entity-for-nongeographic-intent"

# ---------------------------------------------------------------- document text formats
TEXT_VERSIONS = ("v1", "v2", "v2.1")
SELECTABLE_TEXT_VERSIONS = ("v1", "v2.1")
DEFAULT_TEXT_VERSION = "v1"
LINE_ALIASES_EN = "English aliases: {}."
LINE_ALIASES_VI = "Vietnamese aliases: {}."
LINE_REGION = "Region: {}."
LINE_CONTINENT = "Continent: {}."
LINE_COUNTRY_CODE = "Country code: {}."
LINE_COUNTRY = "Country: {}."
LINE_CAPITAL = "Capital: {}."
LINE_CURRENCY = "Currency: {}."
LINE_LANGUAGES = "Languages: {}."
TYPE_SENTENCES = {
    "country": ("{} is a country.", "{} là một quốc gia."),
    "city": ("{} is a city.", "{} là một thành phố."),
    "landmark": ("{} is a landmark.", "{} là một địa danh."),
}
PLACE_IN_COUNTRY_SENTENCES = {
    "city": ("{} is a city in {}.", "{} là một thành phố ở {}."),
    "landmark": ("{} is a landmark in {}.", "{} là một địa danh ở {}."),
}
CITY_IS_CAPITAL_SENTENCES = ("{} is the capital city of {}.", "{} là thủ đô của {}.")
COUNTRY_CAPITAL_SENTENCES = {
    "v2": ("The capital city of {} is {}.", "Thủ đô của {} là {}."),
    "v2.1": ("{} has {} as its capital.", "{} có thủ đô là {}."),
}
CURRENCY_SENTENCES = ("{} uses {} as its currency.", "{} sử dụng {} làm tiền tệ.")

# ---------------------------------------------------------------- ids, embedding input formats
UUID_NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
UUID_NAMESPACE_DNS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
POINT_ID_PREFIX = "entity:"
QUERY_PREFIX = "query: "
DOCUMENT_PREFIX = "passage: "
QUERY_INSTRUCTION = "Instruct: Retrieve the geographic entity that best answers the query\nQuery:"
INSTRUCTION_ID_PREFIX = "geo-retrieval-v1:"
MAX_EMBED_BATCH = 256
PAYLOAD_RUNTIME_FIELDS = (
    "backend", "implementation", "semantic", "accelerator", "device", "dtype", "runtime",
    "profile", "query_strategy", "query_instruction_id", "document_strategy",
)
SEMANTIC_RUNTIME_FIELDS = ("profile", "query_strategy", "query_instruction_id", "document_strategy")

# ---------------------------------------------------------------- search
KEYWORD_FILTERS = ("type", "continent", "region", "country_code", "source")
RANGE_FILTER = "population"
RANGE_OPS = ("gt", "gte", "lt", "lte")
QUERY_LANGUAGES = ("auto", "en", "vi")
MAX_QUERY_CHARS = 1000
DEFAULT_LIMIT = 10
MAX_LIMIT = 100
DEFAULT_SCORE_THRESHOLD = 0.55
DEFAULT_CANDIDATE_MULTIPLIER = 5

# ---------------------------------------------------------------- evaluation
EVALUATION_LIMIT = 5
RECALL_KS = (1, 3, 5)
CASE_LANGUAGES = ("en", "vi")
CATEGORY_TYPES = {"country-factual": "country", "city-capital": "city", "city-alias": "city", "no-answer": None}
DEFAULT_CATEGORY = "uncategorized"
PERCENTILES = (50, 90, 95, 99)
DEFAULT_THRESHOLDS = tuple(round(0.30 + i * 0.01, 6) for i in range(41))
CURRENT_THRESHOLD = 0.55
LOWER_THRESHOLD = 0.53
WILSON_Z = 1.959963984540054
RELATION_WEIGHTS = {"country": 8, "name_en": 8, "name_vi": 8, "country_code": 4, "region": 2, "continent": 1}
STRESS_TIERS = (
    "all-country", "all-capital-city", "expected", "hard-report-distractor",
    "capital-locality", "related-major-city", "global-major-city", "deterministic-filler",
)
STRESS_MANDATORY_TIERS = 4
TARGETED_CHALLENGES = ("contradictory-geography", "plausible-absent-entity")
SENTINEL_TYPE_TOKENS = ("city", "country", "landmark", "region", "geographic")
RECOMMENDATIONS = {
    "false_positives": ("retain-production-investigate-false-positives", "CURRENT_THRESHOLD_HAS_ADVERSARIAL_FALSE_POSITIVES"),
    "promote": ("promote-candidate", "RECALL_GAIN_WITHOUT_FP_REGRESSION"),
    "more_false_positives": ("retain-production", "LOWER_THRESHOLD_INCREASES_FALSE_POSITIVES"),
    "no_gain": ("retain-production", "NO_RECALL_GAIN_FROM_LOWER_THRESHOLD"),
}
# Gate bounds: (check, scope, key, bound); scope picks the quality group the check reads.
FOCUSED_GATE = (
    ("country_factual_recall", "category", "country-factual", 0.95),
    ("hard_negative_recall", "challenge", "hard-negative", 14 / 15),
    ("city_capital_recall", "category", "city-capital", 11 / 12),
    ("compressed_recall", "challenge", "compressed", 0.8),
    ("implicit_relation_recall", "challenge", "implicit-relation", 1.0),
)
GAIN_GATE = {"overall": 0.025, "without_challenge": 0.02, "challenge": "no-diacritics"}
NO_REGRESSION_GROUPS = (
    ("category", "city-capital"), ("category", "country-factual"),
    ("challenge", "compressed"), ("challenge", "implicit-relation"),
)
HARD_NEGATIVE = ("challenge", "hard-negative", 14 / 15)
PRODUCTION_FLOORS = {"recall_at_1": 0.9875, "mrr": 0.99375, "recall_at_3": 1.0, "recall_at_5": 1.0}
