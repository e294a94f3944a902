"""Patterns of variable tokens.  All of them are fixed values, which results depend on."""

# The variable tokens of the simple tokeniser, in order of preference.
SIMPLE = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|\[\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}\]"
    r"|\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
    r"|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d{1,5})?"
    r"|0x[0-9a-fA-F]+"
    r"|https?://\S+"
    r"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
)

# The kinds of the structural tokeniser, in order of preference; only id ignores case.
KINDS = {
    "timestamp": r"(?:\[\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}\]|\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b)",
    "uuid": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    "url": r"https?://[^\s\"'>]+",
    "query": r"\?[A-Za-z0-9_.%+\-]+=[^&\s]*(?:&[A-Za-z0-9_.%+\-]+=[^&\s]*)+",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "ipv4": r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b",
    "ipv6": r"\b(?:[0-9A-Fa-f]{1,4}:){2,}[0-9A-Fa-f:.]+\b",
    "path": r"(?:(?:[A-Za-z]:)?(?:\.\.?/|/))[^\s\"'<>|,;]*[A-Za-z0-9_\-/]",
    "hex": r"\b(?:0x[0-9A-Fa-f]+|[0-9A-Fa-f]{16,})\b",
    "id": r"(?i:\b(?:req(?:uest)?|trace|user|session)[-_]?(?:id[-_:]?)?[A-Za-z0-9]{4,}(?:-[A-Za-z0-9]{2,})*\b)",
    "number": r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?",
}

# The order in which literals are normalised, and what stands for each kind.
NORMAL_ORDER = ("uuid", "timestamp", "email", "url", "query", "ipv4", "ipv6", "path", "hex", "id", "number")
NORMAL_NAMES = {"number": "<num>"}

# Fixed value: key=value; group 1 is the key, group 2 the value.
KEY_VALUE = r"""(\b[A-Za-z_][A-Za-z0-9_.-]*)=("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\[[^\]\n]*\]|[^\s,;|]+)"""

# Fixed value: integers that print as they are written.
CANONICAL_INT = r"^(0|-?[1-9][0-9]*)$"

# What JSON takes for a string, a number and blanks.
JSON_STRING = r'"(?:\\.|[^"\\])*"'
JSON_NUMBER = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"
JSON_BLANK = r"[ \t\r\n]*"
