"""Word lists, colours, limits and file endings.

Results depend on these being exactly so; nothing here is logic.
"""

# File endings.
JAVASCRIPT_ENDINGS = ("js", "jsx", "mjs", "cjs")
TYPESCRIPT_ENDINGS = ("ts", "tsx")
PYTHON_ENDINGS = ("py", "pyw")

# Words and symbols counted as operators.
JS_KEYWORDS = (
    "break", "case", "catch", "continue", "debugger", "default", "delete",
    "do", "else", "finally", "for", "function", "if", "in", "instanceof",
    "new", "return", "switch", "this", "throw", "try", "typeof", "var",
    "void", "while", "with", "class", "const", "enum", "export", "extends",
    "import", "super", "implements", "interface", "let", "package", "private",
    "protected", "public", "static", "yield", "async", "await", "of",
)
PY_KEYWORDS = (
    "False", "None", "True", "and", "as", "assert", "async", "await",
    "break", "class", "continue", "def", "del", "elif", "else", "except",
    "finally", "for", "from", "global", "if", "import", "in", "is",
    "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try",
    "while", "with", "yield",
)
JS_SYMBOLS = (
    "+", "-", "*", "/", "%", "**", "=", "+=", "-=", "*=", "/=", "%=",
    "**=", "==", "!=", "===", "!==", "<", ">", "<=", ">=", "&&", "||",
    "!", "&", "|", "^", "~", "<<", ">>", ">>>", "?", ":", "??", "?.",
    "++", "--", "=>", "...", "&&=", "||=", "??=",
)
PY_SYMBOLS = (
    "+", "-", "*", "/", "//", "%", "**", "=", "+=", "-=", "*=", "/=",
    "//=", "%=", "**=", "==", "!=", "<", ">", "<=", ">=", "and", "or",
    "not", "in", "is", "&", "|", "^", "~", "<<", ">>", ":=", "->", ":",
)

# Characters a symbol run or a quoted literal can begin with.
NON_OPERAND_HEADS = [
    "+", "-", "*", "/", "%", "=", "!", "<", ">", "&", "|", "^", "~", "?", ":", '"', "'", "`",
]

# Bands as (limit, label, colour, level).
CC_BANDS = (
    (5, "Low", "#3fb950", 0),
    (10, "Moderate", "#d29922", 1),
    (20, "High", "#f85149", 2),
)
CC_WORST = ("Critical", "#da3633", 3)
MI_BANDS = (
    (80, "Excellent", "#3fb950", 0),
    (60, "Good", "#58a6ff", 1),
    (40, "Moderate", "#d29922", 2),
    (20, "Poor", "#f85149", 3),
)
MI_WORST = ("Critical", "#da3633", 4)

# Default limits and the points where a finding turns critical.
DEFAULT_LIMITS = {"loc": 50, "nesting": 3, "params": 5, "cc": 10}
CRITICAL_LOC = 100
CRITICAL_NESTING = 5
CRITICAL_CC = 20
MAX_RETURNS = 3
MAX_CASES = 10
DECOMPOSE_CC = 15
FALLBACK_LINES = 50
DUPLICATE_MIN_LOC = 5
HISTORY_PAGE = 50
DEFAULT_FILENAME = "untitled.js"
UNSUPPORTED = "Unsupported language"

# Display colours and icons.
SEVERITY_ICONS = {"critical": "⛔", "warning": "⚠️", "info": "ℹ️"}
PRIORITY_COLORS = {"high": "#f85149", "medium": "#d29922", "low": "#3fb950"}
ISSUES_SOME, ISSUES_NONE = "#d29922", "#3fb950"
SUGGESTIONS_SOME, SUGGESTIONS_NONE = "#58a6ff", "#3fb950"
