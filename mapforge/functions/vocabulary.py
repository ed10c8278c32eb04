"""Word lists, patterns, weights and thresholds of the mapping rules.

All of these are fixed values: results depend on them exactly.
"""

# fixed values: abbreviations in column names, each with the words it stands for
ABBREVIATIONS = {
    "hq": "headquarters",
    "url": "web address link",
    "msrp": "manufacturer suggested retail price list price",
    "sku": "stock keeping unit",
    "qty": "quantity",
    "amt": "amount",
    "dt": "date time",
    "ts": "date time",
    "num": "number",
    "no": "number",
    "pct": "percent",
    "org": "organization",
    "mfr": "manufacturer",
    "addr": "address",
    "tel": "telephone",
    "yr": "year",
    "id": "identifier",
    "desc": "description",
    "cnt": "count",
    "emp": "employee",
}

# fixed values: words that mean the same in names of attributes
NAME_GROUPS = (
    ("website", "url", "homepage", "web", "site"),
    ("founded", "established", "started", "inception"),
    ("sector", "industry", "vertical"),
    ("vendor", "supplier", "company", "organization"),
    ("price", "msrp", "cost", "list"),
    ("manufacturer", "maker", "producer", "brand"),
    ("count", "size", "headcount", "employees", "employee"),
)

# fixed values: words that mean the same when concepts are searched ("list" is not among the prices here)
SEARCH_GROUPS = (
    ("website", "url", "homepage", "web", "site"),
    ("founded", "established", "started", "inception"),
    ("sector", "industry", "vertical"),
    ("vendor", "supplier", "company", "organization"),
    ("price", "msrp", "cost"),
    ("manufacturer", "maker", "producer", "brand"),
    ("count", "size", "headcount", "employees", "employee"),
)

# fixed values
STOP_WORDS = tuple("of the a an and or in on at to for by with from as is are be its it this that primary e.g.".split())
VACUOUS_NAMES = tuple("data value info extra misc meta other field notes_field payload".split())
PLACEHOLDER_NAMES = tuple("val tmp temp x attr attribute item thing stuff".split())
QUANTITY_WORDS = tuple("count size qty quantity amount number total num".split())
VACUOUS_COLUMNS = tuple("date time value amount number data type status info detail details field misc other flag".split())
SYNC_COLUMNS = tuple("updated_at created_at modified_at last_modified _rev __v etl_loaded_at ingested_at row_number index".split())
SENTINELS = ("direct", "n/a", "-", "none", "unknown", "")
BOOLEAN_WORDS = ("true", "false", "yes", "no")
DATATYPES = ("string", "integer", "number", "boolean", "date", "datetime")
SEVERITIES = ("warning", "error", "info")

# fixed values: whole-value patterns
INTEGER = r"^[+-]?\d+$"
NUMBER = r"^([+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?))$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)?$"
URL = r"(?i)^https?://\S+$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
HEX_ID, HEX_LETTER = r"(?i)^[0-9a-f]{6,}$", r"(?i)[a-f]"
CURRENCY = r"^[$€£]\s?-?\d[\d,]*(\.\d+)?$"
UNNAMED = r"(?i)^unnamed[:\s_]*\d*$"
SURROGATE = r"(?i)^_?(id|_id|uuid|guid|pk|row_?id)$"
VACUOUS_TEXT = r"(?i)^(misc|miscellaneous|other|various|tbd|n/a)\b"
SNAKE_CASE, PASCAL_CASE = r"^[a-z][a-z0-9_]*$", r"^[A-Z][A-Za-z0-9]*$"

# fixed values: profiles
AGREEMENT = 0.9
FREETEXT_LENGTH, FREETEXT_UNIQUENESS = 25, 0.8
ENTITY_LENGTH, ENTITY_UNIQUENESS, ENTITY_CAPITALS, ENTITY_VALUES = 40, 0.8, 0.6, 10
SAMPLES = 5

# fixed values: search
K1, B = 1.5, 0.75
WEIGHTS = {"bm25": 0.35, "embedding": 0.40, "datatype": 0.15, "shape": 0.10}
VACUOUS_FACTOR, OUT_OF_SCOPE_FACTOR, ORPHAN_FACTOR = 0.15, 0.6, 0.25
COLUMN_K, TYPE_K, TYPES = 8, 20, 5

# fixed values: near-duplicate types
NEAR_DUPLICATE, NEAR_DUPLICATE_RESCUE, RESCUE_COSINE = 0.5, 0.4, 0.8

# fixed values: decisions
REUSE_SCORE, REUSE_SCORE_CONFLICT = 0.62, 0.55
MARGIN, MARGIN_TOP = 0.05, 0.5
LOW_CONFIDENCE, OVERRIDE_GAP, SUBJECT_FLOOR = 0.55, 0.15, 0.05
BUDGET, DOWNGRADE = 2, 0.8
GATE_PRIORITY = {
    "datatype_conflict": 0,
    "kind_mismatch": 0,
    "unknown_target": 0,
    "low_confidence": 1,
    "llm_escalate": 1,
    "near_duplicate": 2,
    "retrieval_override": 2,
    "score_margin_ambiguous": 3,
    "vacuous_source": 3,
}
#: What an unanswered question falls back to; "top" is the best candidate, where there is no conflict of datatypes.
DEFAULT_ANSWER = {"near_duplicate": "top", "retrieval_override": "top", "datatype_conflict": "exclude", "unknown_target": "exclude", "kind_mismatch": "exclude"}
