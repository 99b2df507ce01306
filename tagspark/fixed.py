"""Word lists, tables, patterns and formats that results depend on.

They are data, not logic; every operator that uses one takes it as a parameter
and falls back to the value here.
"""

# --- fixed values: the controlled vocabulary, general -> specifics -----------
TAXONOMY = {
    "accessories": ["accessories"],
    "awards": ["awards"],
    "benchmark": ["benchmark"],
    "bonus": ["bonus"],
    "dimension": ["dimension"],
    "energy rating": ["energy rating"],
    "feature graphics": [
        "ai", "application", "battery life", "camera", "compatibility",
        "call quality", "connectivity", "durability", "gaming",
        "picture quality", "portability", "sound quality", "comfort",
        "sustainability", "controls", "customisability",
    ],
    "person": ["social group"],
    "product summary": ["product summary"],
    "physical design": [
        "back angle", "colour", "front angle", "multiple angles", "side angle",
        "earbuds", "case", "top", "bottom", "left", "right",
    ],
    "usage scene": ["indoor", "outdoor", "transport"],
    "whats in the box": ["whats in the box"],
}
OBSERVED_EXTRA = ["left", "right"]
HIGHLIGHT_GENERAL = "feature graphics"

# --- fixed values: which words in a text earn which non-visual tag -----------
EVIDENCE_RULES = {
    "awards": ["award", "winner", "best of", "editors choice", "editor's choice",
               "accolade", "prize", "recognised", "recognized"],
    "benchmark": ["benchmark", "test results", "lab test", "measured",
                  "score of", "rtings", "displaymate"],
    "energy rating": ["energy rating", "energy label", "energy class",
                      "energy efficiency", "eu energy"],
}

# --- fixed values: sheet header word -> field, most specific first -----------
COLUMN_HINTS = [
    ("price", "price"),
    ("view", "views"), ("impression", "views"),
    ("categor", "category"),
    ("filename", "file"), ("file name", "file"), ("file", "file"),
    ("image name", "file"),
    ("product name", "product"), ("model", "product"), ("product", "product"),
    ("name", "file"),
]

# --- fixed values: items ------------------------------------------------------
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp"]
KNOWN_CATEGORIES = ["mobile", "tv", "video & sound", "headphone", "speaker"]
MAGIC_BYTES = [
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
]
FALLBACK_MEDIA_TYPE = "image/jpeg"

# --- fixed values: answers ----------------------------------------------------
DETAIL_LABELS = ["category", "model", "description", "specs"]
NOTHING_WORDS = ["unknown", "none", "n/a", "na", "not shown", "not visible", "-"]

# --- fixed values: errors worth another try -----------------------------------
TRANSIENT_STATUS = [408, 409, 429]
TRANSIENT_TYPES = [
    "RateLimitError", "APIConnectionError", "APITimeoutError",
    "InternalServerError", "APIStatusError", "ConnectionError",
    "Timeout", "TimeoutError", "ServiceUnavailable",
]

# --- fixed values: thresholds -------------------------------------------------
TARGET_MICRO_F1 = 0.75
TARGET_MACRO_F1 = 0.40
UNSTABLE_BELOW = 0.7
MIN_SUPPORT = 2
MAX_PASSES = 2
SECOND_DRAW_SEED = 17

# --- fixed values: review table -----------------------------------------------
VERDICTS = {"none": "Needs a look", "clean": "High", "one": "Medium", "more": "Needs a look"}
WARNING_TEXTS = {
    "again": "re-prompted",
    "unexplained": "some tags unexplained",
    "single": "only one tag",
    "untagged": "nothing was tagged",
    "clean": "clean first answer, every tag explained",
}
OPTIONAL_COLUMNS = ["Product", "Category", "Description", "Specs", "Price", "Views"]

# --- fixed values: run records, the arguments that change an outcome -----------
RECORDED_SETTINGS = [
    "provider", "model", "few_shot", "workers", "limit", "enrich",
    "search_tool", "no_memory", "sample", "input", "train_dir",
    "results", "metadata", "from_sheet", "synthetic", "metric",
    "min_support",
]
SETTINGS_UNUSED_FROM_SHEET = ["provider", "model", "workers", "limit"]
