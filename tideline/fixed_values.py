"""Names, word lists, patterns and limits that decide what the results are.

They are data, not logic.  Patterns are written in Java regular-expression syntax.  ``(?U)`` makes
``\\s``, ``\\d``, ``\\w`` and ``\\b`` follow Unicode, ``(?iu)`` compares letters case-insensitively.
"""

# --- wire format -------------------------------------------------------------------------------
EVENT_TYPES = ("view", "search", "review")
V1_FIELDS = ("event_id", "event_type", "product_id", "shade_id", "user_id", "rating", "produced_at_ms")
DEFAULT_CHANNEL = "app"
RATING_MIN, RATING_MAX = 1, 5
INT_MIN, INT_MAX = -2147483648, 2147483647
# first and last millisecond of the years 1 to 9999
MS_MIN, MS_MAX = -62135596800000, 253402300799999

# --- reports -----------------------------------------------------------------------------------
TOP_K = 20
RECOVERED_BACKLOG = 1000
ROW_GROUP_ROWS = 100_000
UNSPECIFIED_SHADE = "unspecified"
UNSPECIFIED_HEX = "#000000"
UNKNOWN_REASON = "unknown"

# --- white space as seen by the text rules (Unicode white space and the four separators) ----------
SPACE = r"[\s\x1c-\x1f]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- shade names -------------------------------------------------------------------------------
PARENTHESES = r"\([^)]*\)"
SHADE_SEPARATORS = r"[^a-z0-9#]+"
SHADE_HASH_CODE = r"#\s*\d{1,3}"
SHADE_LEADING_NO = r"^no\s+\d{1,3}\s+"
SHADE_TRAILING_CODE = r"\s+\d{1,3}$"
SHADE_LEADING_CODE = r"^\d{1,3}\s+(?=[a-z])"
WORD_SEPARATORS = r"[^a-z0-9]+"

# --- ingredient lists ----------------------------------------------------------------------------
INGREDIENT_LABEL = rf"(?iuU)^{SPACE}*(?:ingredients?|ingr[eé]dients?|inci){SPACE}*:{SPACE}*"
# signs that separate ingredients; "/" joins two names of one, which are kept apart as well
INGREDIENT_SIGNS = r"[,;•\r\n/]+"
# the patterns below work on one ingredient per line and do not cross lines
PERCENTAGE = r"(?U)\b\d+([.,]\d+)?[\s\x1c-\x1f&&[^\n]]*%"
LINE_PARENTHESES = r"\([^)\n]*\)"
INGREDIENT_SEPARATORS = r"[^a-z0-9/ \-\n]+"
COLOUR_INDEX = r"^ci *(\d{5})$"
INGREDIENT_ALIASES = {
    "aqua": "water",
    "eau": "water",
    "water": "water",
    "parfum": "fragrance",
    "perfume": "fragrance",
    "fragrance": "fragrance",
    "cera alba": "beeswax",
    "mica": "mica",
}

# --- shades inside product names -----------------------------------------------------------------
SHADE_TAIL = rf"(?U)(\d{{2,3}}{SPACE}+[A-Z][\w'’\-]+(?:{SPACE}+[A-Z][\w'’\-]+){{0,2}}){SPACE}*\z"
SHADE_NUMBER = rf"(?iuU)((?:No\.?|#){SPACE}?\d{{1,4}})\)?{SPACE}*\z"

# --- makeup filter -------------------------------------------------------------------------------
MAKEUP = (
    r"(?iu)makeup|make-up|lipstick|lip-gloss|lip-balm|foundation|mascara|eye-?shadow|eyeliner|nail-polish|blush|"
    r"concealer|face-powder|bronzer|highlighter|eyebrow|lip-liner|rouges?-a-levres|vernis"
)
NOT_MAKEUP = r"(?iu)remover|hair|shampoo|conditioner|soap|shower"
DEFAULT_CATEGORY = "makeup"
