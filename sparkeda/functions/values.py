"""Fixed values that results depend on.

These lists are behaviour, not code: role detection, cleaning and image
intake must use exactly these words to classify columns the same way.
"""

# --- fixed values: name fragments marking an identifier column (key detection) ---
KEY_NAME_PATTERNS = [
    "id", "identifier", "key", "pk", "primary_key", "uuid", "guid",
    "code", "number", "num", "no", "ref", "reference", "index",
    "email", "mail", "username", "user_name", "login",
]

# --- fixed values: name fragments that rule a near-unique numeric column out of statistics ---
SENSIBLE_ID_PATTERNS = ["id", "identifier", "key", "code", "number", "num", "no", "ref", "reference"]

# --- fixed values: name fragments of phone-number columns ---
PHONE_PATTERNS = ["mobile", "phone", "contact", "tel", "cell"]

# --- fixed values: name fragments of identifier-like string columns (categorical test) ---
IDENTIFIER_KEYWORDS = ["id", "identifier", "key", "code", "name", "email", "mail"]
EMAIL_KEYWORDS = ["email", "mail"]

# --- fixed values: boolean word pairs converted to 1/0 ---
BOOLEAN_WORD_PAIRS = [("yes", "no"), ("true", "false")]
# words that mark a low-cardinality column as categorical before date parsing
CATEGORICAL_WORDS = ["yes", "no", "true", "false", "y", "n"]

# --- fixed values: default missing-value tokens of the CSV reader ---
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: image file suffixes accepted in an image set ---
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".webp"]

# labels of the missing bucket
NODATA = "NoData"
NO_VALUE = "No Value"

# Date formats tried, in order, when a string column is tested for dates.
# Month-first for the ambiguous slash form.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "yyyy/MM/dd",
    "dd-MM-yyyy",
    "yyyyMMdd",
    "M/d/yyyy",
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
]

# Pattern of a plain decimal number; Spark's cast alone also accepts '1d', '1.5f'.
NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def name_has(name: str, patterns) -> bool:
    """Substring test on the lower-cased column name (``no`` hits ``notes``)."""
    low = str(name).lower()
    return any(p in low for p in patterns)
