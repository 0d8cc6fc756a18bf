"""The queries of ``srcgauge.catalog`` in DuckDB SQL, written independently.

Function ends are found here with running brace sums and joins, duplicates with
a plain self-join: other ways than the Spark side takes.
"""

from __future__ import annotations

from srcgauge.sources.corpora import DOC_ENDINGS, JS_PARAMS, NOTE, PY_PARAMS

SPACE = r"[ \t\n\x0B\f\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
EOL = r"[^\n\r\x{2028}\x{2029}]"


def q(text: str) -> str:
    """A text as SQL literal; newlines by chr."""
    quoted = (p.replace("'", "''") for p in text.split("\n"))
    return "||chr(10)||".join(f"'{p}'" for p in quoted)


def words(items: tuple[str, ...]) -> str:
    return "[" + ",".join(q(w) for w in items) + "]"


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


PY_OPS = words(PY_KEYWORDS + PY_SYMBOLS)
JS_OPS = words(JS_KEYWORDS + JS_SYMBOLS)


# -- inputs -------------------------------------------------------------------
_doc_case = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(DOC_ENDINGS))
LANGUAGE = (
    "CASE WHEN ext IN ('js','jsx','mjs','cjs') THEN 'javascript' "
    "WHEN ext IN ('ts','tsx') THEN 'typescript' WHEN ext IN ('py','pyw') THEN 'python' "
    "ELSE 'unknown' END"
)
DOCS = f"""
doc_raw AS (SELECT doc_id AS file_id, text AS code,
  CASE doc_id % 9 {_doc_case} END AS ext FROM documents),
all_docs AS (SELECT file_id, 'doc_' || file_id || '.' || ext AS filename, code,
  {LANGUAGE} AS language FROM doc_raw),
src AS (SELECT * FROM all_docs WHERE language <> 'unknown')"""


def _opt(condition: str, text: str) -> str:
    return f"(CASE WHEN {condition} THEN {q(text)} ELSE '' END)"


_py_nested = "||".join(_opt(f"k % 7 >= {i}", f"{'    ' * i}if a > {i}:\n") for i in range(1, 7))
_py = "||".join(
    [
        "repeat(chr(10), k % 3)",
        "'def f'||k||'(a'",
        f"substring({q(PY_PARAMS)}, 1, 13 * (s % 8))",
        q(f"):\n    # {NOTE}\n"),
        f"repeat({q(chr(32) * 4 + 'if a and p1:  # note' + chr(10) + ' ' * 8 + 'return a' + chr(10))}, k % 6)",
        _py_nested,
        "repeat(' ', 4 * (k % 7 + 1))",
        q("total = 'a' if a or p1 else 0\n"),
        "repeat('    total = total + '||s||chr(10), 2 * s)",
        _opt("k % 11 = 0", "    match a:\n" + "        case 1:\n            total = 1\n" * 12),
        q("    return total"),
    ]
)
_js_params = f"'(a'||substring({q(JS_PARAMS)}, 1, 4 * (s % 8))||')'"
_js = "||".join(
    [
        f"CASE k % 4 WHEN 0 THEN 'function f'||k||{_js_params}||' {{'"
        f" WHEN 1 THEN 'const f'||k||' = '||{_js_params}||' => {{'"
        f" WHEN 2 THEN 'async function f'||k||{_js_params}||' {{'"
        f" ELSE 'f'||k||' = '||{_js_params}||' => {{' END",
        q(f"\n// {NOTE}\n"),
        _opt(
            "k % 5 = 0",
            'let u = "http://x"; /* unit\n price */\n'
            "if (a ?? p) {\n  return 1;\n} else if (a ? p : a?.b) {\n  return `two`;\n}\n",
        ),
        f"repeat({q('if (a > 1 && p) {' + chr(10))}, k % 7)",
        "repeat('total += '||s||'; // step'||chr(10), 2 * s)",
        _opt("k % 11 = 0", "switch (a) {\n" + "case 1: break;\n" * 12 + "}\n"),
        q("return total;\n"),
        "repeat('}'||chr(10), k % 7 + 1)",
    ]
)
CODE = f"""
fn_src AS (SELECT p_partkey AS k, p_size AS s, p_partkey // 5 AS file_id FROM part),
fn_txt AS (SELECT k, file_id, CASE WHEN file_id % 2 = 0 THEN {_py} ELSE ({_js}) END AS fn
  FROM fn_src),
src AS (SELECT file_id,
  'file_' || file_id || CASE WHEN file_id % 2 = 0 THEN '.py' ELSE '.js' END AS filename,
  string_agg(fn, chr(10) ORDER BY k) AS code,
  CASE WHEN file_id % 2 = 0 THEN 'python' ELSE 'javascript' END AS language
  FROM fn_txt GROUP BY file_id)"""


# -- text and metrics ---------------------------------------------------------
def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, '{to}', 'g')"


def strip_sql(x: str, python: bool) -> str:
    if python:
        x = sub(x, r"'''[\s\S]*?'''", "")
        x = sub(x, r'"""[\s\S]*?"""', "")
        x = sub(x, f"#{EOL}*", "")
    else:
        x = sub(x, r"/\*[\s\S]*?\*/", "")
        x = sub(x, f"//{EOL}*", "")
        x = sub(x, "`[^`]*`", '""')
    return sub(sub(x, "'[^']*'", '""'), '"[^"]*"', '""')


def clean_sql(x: str) -> str:
    return (
        f"CASE WHEN language = 'python' THEN {strip_sql(x, True)} ELSE {strip_sql(x, False)} END"
    )


def n_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


# Decision patterns.
JS_KINDS = {
    "if": r"\bif\b", "else_if": rf"\belse{SPACE}+if\b", "for": r"\bfor\b", "while": r"\bwhile\b",
    "case": r"\bcase\b", "catch": r"\bcatch\b", "ternary": rf"\?{SPACE}*[^:]", "and": "&&",
    "or": r"\|\|", "nullish": r"\?\?",
}
PY_KINDS = {
    "if": r"\bif\b", "elif": r"\belif\b", "for": r"\bfor\b", "while": r"\bwhile\b",
    "except": r"\bexcept\b", "and": r"\band\b", "or": r"\bor\b",
    "if_else": rf"\bif\b{EOL}*\belse\b",
}


def cc_sql(x: str, service: bool = False) -> str:
    py = [p for k, p in PY_KINDS.items() if not (service and k == "if_else")]
    python = " + ".join(n_of(x, p) for p in py)
    braces = " + ".join(n_of(x, p) for p in JS_KINDS.values())
    return f"1 + CASE WHEN language = 'python' THEN {python} ELSE {braces} END"


# Fixed value: the token pattern.
TOKEN = r"[a-zA-Z_$]\w*|[+\-*/%=!<>&|^~?:]+|\d+\.?\d*"
QUOTED = "|\"[^\"]*\"|'[^']*'|`[^`]*`"


def half_up(x: str, digits: int = 2) -> str:
    scale = 10**digits
    return f"floor(({x}) * {scale}.0::DOUBLE + 0.5) / {scale}.0::DOUBLE"


def metrics_ctes(name: str, source: str, keys: str, body: str, service: bool = False) -> str:
    """CTEs ``<name>``: keys plus cc, the Halstead fields and mi of a body.

    ``source`` must have the keys, language, the body and ``loc``.
    """
    token = q(TOKEN if service else TOKEN + QUOTED)

    def round_(x: str, digits: int = 2) -> str:
        if service:
            # printf rounds the exact binary value, ties to even
            return f"format('{{:.{digits}f}}', {x})::DOUBLE"
        return half_up(x, digits)

    return f"""
{name}_c AS (SELECT {keys}, language, loc, {clean_sql(body)} AS clean FROM {source}),
{name}_t AS (SELECT {keys}, language, loc, {cc_sql("clean", service)} AS cc,
  regexp_extract_all(clean, {token}) AS toks FROM {name}_c),
{name}_o AS (SELECT {keys}, loc, cc,
  CASE WHEN language = 'python' THEN list_filter(toks, lambda t: list_contains({PY_OPS}, t))
    ELSE list_filter(toks, lambda t: list_contains({JS_OPS}, t)) END AS ops,
  CASE WHEN language = 'python'
    THEN list_filter(toks, lambda t: NOT list_contains({PY_OPS}, t) AND regexp_matches(t, '^[a-zA-Z_$0-9]'))
    ELSE list_filter(toks, lambda t: NOT list_contains({JS_OPS}, t) AND regexp_matches(t, '^[a-zA-Z_$0-9]'))
  END AS opnds FROM {name}_t),
{name}_n AS (SELECT {keys}, loc, cc, len(list_distinct(ops)) AS n1, len(list_distinct(opnds)) AS n2,
  len(ops) AS t1, len(opnds) AS t2 FROM {name}_o),
{name}_v AS (SELECT *, CASE WHEN t1 + t2 > 0 THEN (t1 + t2) * log2((n1 + n2)::DOUBLE) ELSE 0.0 END::DOUBLE AS v,
  CASE WHEN n2 > 0 THEN (n1 / 2.0::DOUBLE) * (t2::DOUBLE / n2::DOUBLE) ELSE 0.0 END::DOUBLE AS d FROM {name}_n),
{name}_h AS (SELECT {keys}, loc, cc::INTEGER AS cc, n1::INTEGER AS uniqueOperators, n2::INTEGER AS uniqueOperands,
  t1::INTEGER AS totalOperators, t2::INTEGER AS totalOperands, (n1 + n2)::INTEGER AS vocabulary,
  (t1 + t2)::INTEGER AS length, {round_("v")} AS volume, {round_("d")} AS difficulty,
  {round_("v * d")} AS effort, {round_("v * d / 18.0::DOUBLE")} AS time,
  {round_("v / 3000.0::DOUBLE", 3)} AS bugs FROM {name}_v),
{name} AS (SELECT *, CASE WHEN loc <= 0 OR volume <= 0 THEN 100.0::DOUBLE ELSE
  {round_("greatest(0.0::DOUBLE, least(100.0::DOUBLE, (171 - 5.2::DOUBLE * ln(volume) - 0.23::DOUBLE * cc - 16.2::DOUBLE * ln(loc::DOUBLE)) * 100.0::DOUBLE / 171.0::DOUBLE))")}
  END AS mi FROM {name}_h)"""


HALSTEAD = (
    "uniqueOperators, uniqueOperands, totalOperators, totalOperands, vocabulary, length, "
    "volume, difficulty, effort, time, bugs"
)


def band(x: str, part: int, bands, worst, op: str) -> str:
    whens = " ".join(f"WHEN {x} {op} {b[0]} THEN {q(str(b[part]))}" for b in bands)
    return f"CASE {whens} ELSE {q(str(worst[part - 1]))} END"


def cc_band(x: str, part: int = 1) -> str:
    return band(x, part, CC_BANDS, CC_WORST, "<=")


def mi_band(x: str, part: int = 1) -> str:
    return band(x, part, MI_BANDS, MI_WORST, ">=")


LINES = """
lines AS (SELECT file_id, language, generate_subscripts(ls, 1)::INTEGER AS line, unnest(ls) AS text
  FROM (SELECT file_id, language, string_split(code, chr(10)) AS ls FROM src)),
classed AS (SELECT file_id, language, line, text, ltrim(text, ' ' || chr(9) || chr(13)) AS bare FROM lines),
labelled AS (SELECT file_id, language, line, text, CASE WHEN bare = '' THEN 'blank'
  WHEN language = 'python' AND starts_with(bare, '#') THEN 'comment'
  WHEN language <> 'python' AND (starts_with(bare, '//') OR starts_with(bare, '/*') OR starts_with(bare, '*'))
  THEN 'comment' ELSE 'source' END AS line_class, length(text) - length(bare) AS indent FROM classed),
counts AS (SELECT file_id, count(*)::INTEGER AS loc,
  count(*) FILTER (line_class = 'source')::INTEGER AS sloc,
  count(*) FILTER (line_class = 'blank')::INTEGER AS blankLines,
  count(*) FILTER (line_class = 'comment')::INTEGER AS commentLines FROM labelled GROUP BY file_id)"""


def file_metrics(service: bool = False) -> str:
    return (
        LINES
        + ",\nwith_loc AS (SELECT src.*, counts.loc FROM src JOIN counts USING (file_id)),"
        + metrics_ctes("fm", "with_loc", "file_id", "code", service)
    )


# -- functions ----------------------------------------------------------------
# Function patterns.
JS_PATTERNS = [
    r"(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)",
    r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function\s*)?\(([^)]*)\)\s*(?:=>)?",
    r"(\w+)\s*\(([^)]*)\)\s*\{",
    r"(?:async\s+)?(\w+)\s*=\s*\(([^)]*)\)\s*=>",
]
PY_PATTERN = r"(?m)^(\s*)(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)"
PY_LINE_PATTERN = r"(?m)^([ \t]*)(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)"


def _newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')))"


def _hits(name: str, pattern: str, number: int, where: str, first_group: int) -> str:
    """One row per match with its start line, from the texts between matches."""
    p = q(pattern)
    return f"""
{name}_r AS (SELECT file_id, regexp_extract_all(code, {p}, 0) AS m,
  regexp_extract_all(code, {p}, {first_group}) AS nm, regexp_extract_all(code, {p}, {first_group + 1}) AS pr,
  regexp_extract_all(code, {p}, 1) AS g1, string_split_regex(code, {p}) AS seg FROM src WHERE {where}),
{name}_u AS (SELECT file_id, generate_subscripts(m, 1) - 1 AS seq, unnest(m) AS m, unnest(nm) AS name,
  unnest(pr) AS params, unnest(g1) AS g1, unnest(seg[1:len(m)]) AS seg FROM {name}_r),
{name} AS (SELECT file_id, {number} AS pattern, seq::INTEGER AS seq, name, params, length(g1)::INTEGER AS indent,
  (1 + sum({_newlines("seg")}) OVER w + sum({_newlines("m")}) OVER w - {_newlines("m")})::INTEGER AS startLine
  FROM {name}_u WINDOW w AS (PARTITION BY file_id ORDER BY seq))"""


PARAMS_JS = "list_filter(list_transform(string_split(params, ','), lambda p: trim(p, ' ' || chr(9) || chr(10))), lambda p: p <> '')"
PARAMS_PY = (
    "list_filter(list_transform(string_split(params, ','), lambda p: "
    "trim(split_part(split_part(p, ':', 1), '=', 1), ' ' || chr(9) || chr(10))), "
    "lambda p: p NOT IN ('', 'self', 'cls'))"
)


def function_ctes(service: bool = False, py_pattern: str = PY_PATTERN) -> str:
    count = 3 if service else 4
    js = ",".join(
        _hits(f"js{k}", JS_PATTERNS[k - 1], k, "language <> 'python'", 1)
        for k in range(1, count + 1)
    )
    union = " UNION ALL ".join(f"SELECT * FROM js{k}" for k in range(1, count + 1))
    return f"""{LINES},{js},{_hits("py", py_pattern, 1, "language = 'python'", 2)},
js_all AS ({union}),
js_first AS (SELECT * FROM js_all
  QUALIFY row_number() OVER (PARTITION BY file_id, name, startLine ORDER BY pattern, seq) = 1),
braces AS (SELECT file_id, line, generate_subscripts(b, 1) AS nth, unnest(b) AS ch
  FROM (SELECT file_id, line, regexp_extract_all(text, '[{{}}]') AS b FROM lines WHERE language <> 'python')),
depths AS (SELECT file_id, line, ch, row_number() OVER w AS idx,
  sum(CASE ch WHEN '{{' THEN 1 ELSE -1 END) OVER w AS depth FROM braces
  WINDOW w AS (PARTITION BY file_id ORDER BY line, nth)),
starts AS (SELECT DISTINCT file_id, startLine FROM js_first),
based AS (SELECT s.file_id, s.startLine,
  coalesce(arg_max(d.depth, d.idx) FILTER (d.line < s.startLine), 0) AS base,
  min(d.idx) FILTER (d.line >= s.startLine AND d.ch = '{{') AS opened
  FROM starts s LEFT JOIN depths d USING (file_id) GROUP BY 1, 2),
js_ends AS (SELECT b.file_id, b.startLine, arg_min(d.line, d.idx) AS e FROM based b
  JOIN depths d ON d.file_id = b.file_id AND d.idx >= b.opened AND d.depth = b.base GROUP BY 1, 2),
js_fns AS (SELECT f.file_id, f.pattern, f.seq, f.name, {PARAMS_JS} AS params, f.startLine,
  coalesce(e.e, least(f.startLine - 1 + 50, c.loc)) AS endLine
  FROM js_first f LEFT JOIN js_ends e USING (file_id, startLine) JOIN counts c USING (file_id)),
py_ends AS (SELECT p.file_id, p.seq, min(l.line) - 1 AS e FROM py p JOIN labelled l
  ON l.file_id = p.file_id AND l.line > p.startLine AND l.line_class <> 'blank' AND l.indent <= p.indent
  GROUP BY 1, 2),
py_fns AS (SELECT p.file_id, p.pattern, p.seq, p.name, {PARAMS_PY} AS params, p.startLine,
  coalesce(e.e, c.loc) AS endLine
  FROM py p LEFT JOIN py_ends e USING (file_id, seq) JOIN counts c USING (file_id)),
fns AS (SELECT u.file_id, src.filename, src.language,
  (row_number() OVER (PARTITION BY u.file_id ORDER BY pattern, seq) - 1)::INTEGER AS ord, name,
  params, len(params)::INTEGER AS paramCount, startLine, endLine::INTEGER AS endLine,
  (endLine - startLine + 1)::INTEGER AS loc, counts.loc AS total,
  array_to_string(string_split(code, chr(10))[startLine:endLine], chr(10)) AS body
  FROM (SELECT * FROM js_fns UNION ALL SELECT * FROM py_fns) u
  JOIN src USING (file_id) JOIN counts USING (file_id))"""


_depth_of = """
SELECT file_id, ord, greatest(0, coalesce(max(depth), 0))::INTEGER AS nesting FROM (
  SELECT file_id, ord, sum(CASE ch WHEN '{' THEN 1 ELSE -1 END)
    OVER (PARTITION BY file_id, ord ORDER BY nth) AS depth
  FROM (SELECT file_id, ord, generate_subscripts(b, 1) AS nth, unnest(b) AS ch
    FROM (SELECT file_id, ord, regexp_extract_all(body, '[{}]') AS b FROM fns WHERE language <> 'python')))
GROUP BY 1, 2
UNION ALL
SELECT file_id, ord, ((max(indent) - arg_min(indent, line)) // 4)::INTEGER FROM (
  SELECT f.file_id, f.ord, l.line, l.indent FROM fns f JOIN labelled l
    ON l.file_id = f.file_id AND l.line BETWEEN f.startLine AND f.endLine AND l.line_class <> 'blank'
  WHERE f.language = 'python')
GROUP BY 1, 2"""


def measured_ctes(service: bool = False) -> str:
    """``fx``: functions with cc, Halstead, mi, nesting, returns, heat."""
    return (
        function_ctes(service)
        + ","
        + metrics_ctes("fnm", "fns", "file_id, ord", "body", service)
        + f""",
depth AS ({_depth_of}),
fx AS (SELECT fns.*, fnm.* EXCLUDE (file_id, ord, loc), coalesce(depth.nesting, 0)::INTEGER AS nesting,
  {n_of("body", r"\breturn\b")}::INTEGER AS returns,
  cc::DOUBLE / greatest(1, max(cc) OVER (PARTITION BY fns.file_id)) AS heat
  FROM fns JOIN fnm USING (file_id, ord) LEFT JOIN depth USING (file_id, ord))"""
    )


DUP = r"""
wsets AS (SELECT file_id, ord, name, startLine, loc,
  list_distinct(string_split(trim(regexp_replace(body, '\s+', ' ', 'g')), ' ')) AS ws FROM fns),
dups AS (SELECT * FROM (SELECT a.file_id, a.ord AS i, b.ord AS j, a.startLine AS line, a.name AS first,
  b.name AS second, len(list_intersect(a.ws, b.ws)) AS shared, len(a.ws) + len(b.ws) AS total, a.loc
  FROM wsets a JOIN wsets b ON a.file_id = b.file_id AND a.ord < b.ord AND a.loc > 5)
  WHERE shared::DOUBLE / (total - shared) > 0.8),
pairs AS (SELECT file_id, i, j, line, first, second,
  floor(shared::DOUBLE / (total - shared) * 100 + 0.5)::INTEGER AS percent FROM dups)"""

CASES = rf"""
cased AS (SELECT file_id, language, CASE
  WHEN language = 'python' AND regexp_matches(code, 'match\s+\w+\s*:')
    THEN {n_of("code", "(?m)^" + chr(92) + "s*case" + chr(92) + "s+")}
  WHEN language <> 'python' AND regexp_matches(code, 'switch\s*\([^)]*\)\s*\{{')
    THEN {n_of("code", chr(92) + "bcase" + chr(92) + "b")} ELSE 0 END::INTEGER AS caseCount FROM src)"""


# -- findings -----------------------------------------------------------------
DEFAULTS = {"loc": 50, "nesting": 3, "params": 5, "cc": 10}


def rule_sql(rule: str, service: bool = False, limits: dict[str, int] | None = None) -> str:
    m = limits or DEFAULTS
    tail = "" if service else " — consider simplifying"
    spec = {
        "length": (0, "warning", "max-function-length", "loc > {loc}", f"' is '||loc||' lines long (max {m['loc']})'",
                   "CASE WHEN loc > 100 THEN 'critical' ELSE 'warning' END", "0" if service else "endLine"),
        "nesting": (1, "warning", "max-nesting-depth", "nesting > {nesting}",
                    f"' has nesting depth of '||nesting||' (max {m['nesting']})'",
                    "CASE WHEN nesting > 5 THEN 'critical' ELSE 'warning' END", "0"),
        "params": (2, "warning", "max-params", "paramCount > {params}",
                   f"' has '||paramCount||' parameters (max {m['params']})'", "'warning'", "0"),
        "returns": (3, "info", "multiple-returns", "returns > 3",
                    f"' has '||returns||' return statements{tail}'", "'info'", "0"),
        "complexity": (4, "warning", "high-complexity", "cc > {cc}",
                       f"' has cyclomatic complexity of '||cc||' (threshold: {m['cc']})'",
                       "CASE WHEN cc > 20 THEN 'critical' ELSE 'warning' END", "0"),
    }[rule]
    place, kind, name, test, text, severity, end = spec
    return (
        f"SELECT file_id, ord, {place} AS place, '{kind}' AS type, '{name}' AS rule, "
        f"'Function ''' || name || '''' || {text} AS message, startLine AS line, "
        f"{severity} AS severity, {end}::INTEGER AS endLine FROM fx WHERE {test.format(**m)}"
    )


RULES = ("length", "nesting", "params", "returns", "complexity")
DUP_ISSUE = (
    "'info' AS type, 'duplicate-logic' AS rule, 'Functions ''' || first || ''' and ''' || second || "
    "''' share ' || percent || '% similar structure — consider extracting common logic' AS message, "
    "line, 'info' AS severity, 0 AS endLine"
)
SWITCH_ISSUE = (
    "'warning' AS type, 'large-switch' AS rule, 'Large switch/match block with ' || caseCount || "
    "' cases — consider using a lookup table or strategy pattern' AS message, 1 AS line, "
    "'warning' AS severity, 0 AS endLine"
)


def issues_ctes(service: bool = False, limits: dict[str, int] | None = None) -> str:
    parts = [
        f"SELECT file_id, 0 AS part, ord AS p1, place AS p2, type, rule, message, line, severity, endLine "
        f"FROM ({rule_sql(r, service, limits)})"
        for r in RULES
    ]
    extra = ""
    if not service:
        extra = f",{CASES},{DUP}"
        parts.append(f"SELECT file_id, 1, 0, 0, {SWITCH_ISSUE} FROM cased WHERE caseCount > 10")
        parts.append(f"SELECT file_id, 2, i, j, {DUP_ISSUE} FROM pairs")
    return f"""{measured_ctes(service)}{extra},
issues AS (SELECT file_id,
  (row_number() OVER (PARTITION BY file_id ORDER BY part, p1, p2) - 1)::INTEGER AS issue_ord,
  type, rule, message, line, severity, endLine FROM ({" UNION ALL ".join(parts)}))"""


def suggestion_sql(rule: str, service: bool = False) -> str:
    spec = {
        "decompose": (0, "cc > 15", "decompose", "high", "Decompose Complex Function",
            "'Split ''' || name || ''' into smaller sub-functions. CC=' || cc || "
            + ("'.'" if service else "' suggests multiple responsibilities.'"), "'Extract Method'"),
        "param_object": (1, "paramCount > 5", "parameter-object", "medium", "Use Parameter Object",
            "'Replace ' || paramCount || "
            + ("' parameters with a config object.'" if service
               else "' parameters with a configuration object/dataclass.'"),
            "CASE WHEN language = 'python' THEN 'Use @dataclass' ELSE 'Use Options Object' END"),
        "extract": (2, "loc > 50", "extract-method", "high", "Extract Methods",
            "loc || " + ("' LOC — extract logical blocks into named functions.'" if service else
            "' LOC is too long. Identify logical blocks and extract them into named functions.'"),
            "'Extract Method + Single Responsibility'"),
        "flatten": (3, "nesting > 3", "flatten", "medium", "Reduce Nesting",
            "'Nesting depth of ' || nesting || '. Use early returns, guard clauses, or extract nested blocks.'",
            "'Guard Clause + Early Return'"),
    }[rule]
    place, test, kind, priority, title, description, pattern = spec
    return (
        f"SELECT file_id, ord, {place} AS place, name AS function, startLine AS line, '{kind}' AS type, "
        f"'{priority}' AS priority, '{title}' AS title, {description} AS description, "
        f"{pattern} AS pattern FROM fx WHERE {test}"
    )


def advice_cte(service: bool = False) -> str:
    rules = ["decompose", "param_object", "extract"] + ([] if service else ["flatten"])
    union = " UNION ALL ".join(suggestion_sql(r, service) for r in rules)
    keep = (
        ""
        if service
        else "QUALIFY row_number() OVER (PARTITION BY file_id, function, type ORDER BY ord, place) = 1"
    )
    return f"""
advice_k AS (SELECT * FROM ({union}) {keep}),
advice AS (SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY ord, place) - 1)::INTEGER AS ord,
  function, line, type, priority, title, description, pattern FROM advice_k)"""


# -- assembly of the twins ----------------------------------------------------
def W(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def heat6(x: str) -> str:
    return f"floor(({x}) * 1e6::DOUBLE + 0.5)::BIGINT"


SUMMARY = (
    f"SELECT file_id, filename, language, counts.loc, sloc, blankLines, commentLines, "
    f"cc AS cyclomaticComplexity, {cc_band('cc')} AS complexityLabel, mi AS maintainabilityIndex, "
    f"{mi_band('mi')} AS maintainabilityLabel, {HALSTEAD} "
    "FROM src JOIN counts USING (file_id) JOIN fm USING (file_id)"
)
JOIN_PARAMS = "array_to_string(params, '|') AS params"
FUNCTIONS = (
    f"SELECT file_id, ord, name, startLine, endLine, loc, {JOIN_PARAMS}, paramCount, "
    f"cc AS cyclomaticComplexity, {cc_band('cc')} AS complexityLabel, mi AS maintainabilityIndex, "
    f"{mi_band('mi')} AS maintainabilityLabel, nesting AS maxNestingDepth, "
    f"{heat6('heat')} AS heat_millionths, {HALSTEAD} FROM fx"
)
ISSUE_COLUMNS = "type, rule, message, line, severity, endLine"
ADVICE_COLUMNS = "function, line, type, priority, title, description, pattern"
HEAT_LINES = f"""
hl AS (SELECT file_id, ord, name, cc, heat, {cc_band("cc", 2)} AS color,
  unnest(generate_series(startLine, least(endLine, total)))::INTEGER AS line FROM fx)"""
OVERLAY = """
ov AS (SELECT * FROM hl QUALIFY row_number() OVER (PARTITION BY file_id, line ORDER BY ord DESC) = 1)"""
PAGES_UNION = (
    "SELECT 'web' AS kind, page_id, url, NULL AS shown FROM pages UNION ALL SELECT 'code', file_id, "
    "'https://code.example.com/team' || file_id % 10 || '/project/' || "
    "CASE WHEN file_id % 5 = 4 THEN 'view' ELSE 'blob/main/src/' || filename END, "
    "CASE WHEN file_id % 5 = 4 THEN filename END FROM src"
)
PATH = r"CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?', 1) END"


def rgb(i: int) -> str:
    return f"('0x' || substring(color, {2 + 2 * i}, 2))::INTEGER"


def analysis_sql(service: bool = False) -> str:
    def cents(x: str) -> str:
        return f"floor({x} * 100 + 0.5)::BIGINT"

    file_part = metrics_ctes("fm", "with_loc", "file_id", "code", service)
    ctes = (
        issues_ctes(service)
        + ","
        + advice_cte(service)
        + ",with_loc AS (SELECT src.*, counts.loc FROM src JOIN counts USING (file_id)),"
        + file_part
        + f""",
f_list AS (SELECT file_id, count(*)::INTEGER AS n, string_agg(concat_ws(':', name, startLine, endLine,
  array_to_string(params, '|'), cc, {cc_band("cc", 2)}, {cents("volume")}, {cents("mi")}, nesting),
  chr(10) ORDER BY ord) AS functions, string_agg(concat_ws(':', name, startLine, endLine, {cents("heat")},
  cc, {cc_band("cc", 2)}), chr(10) ORDER BY ord) AS heatmap FROM fx GROUP BY file_id),
i_list AS (SELECT file_id, string_agg(concat_ws(':', {ISSUE_COLUMNS}), chr(10) ORDER BY issue_ord)
  AS linterIssues FROM issues GROUP BY file_id),
a_list AS (SELECT file_id, string_agg(concat_ws(':', {ADVICE_COLUMNS}), chr(10) ORDER BY ord)
  AS refactorSuggestions FROM advice GROUP BY file_id)"""
    )
    return W(
        ctes,
        "SELECT file_id, filename, language, counts.loc, sloc, coalesce(n, 0)::INTEGER AS functionCount, "
        "cc AS cyclomaticComplexity, mi AS maintainabilityIndex, effort, coalesce(functions, '') AS functions, "
        "coalesce(linterIssues, '') AS linterIssues, coalesce(refactorSuggestions, '') AS refactorSuggestions, "
        "coalesce(heatmap, '') AS heatmap FROM src JOIN counts USING (file_id) JOIN fm USING (file_id) "
        "LEFT JOIN f_list USING (file_id) LEFT JOIN i_list USING (file_id) LEFT JOIN a_list USING (file_id)",
    )


STAMP = "strftime(make_timestamp((1704067200 + file_id * 60) * 1000000), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


def history_sql(ctes: str, counts: str, tail: str = "") -> str:
    return W(
        ctes,
        f"SELECT sha256(concat_ws('|', file_id, filename, {STAMP})) AS id, filename, language, "
        f"counts.loc, cc AS complexity, mi AS maintainability, functionCount, issueCount, {STAMP} AS timestamp "
        f"FROM src JOIN counts USING (file_id) JOIN fm USING (file_id) {counts} {tail}",
    )


def history_ctes() -> str:
    return (
        issues_ctes()
        + ",with_loc AS (SELECT src.*, counts.loc FROM src JOIN counts USING (file_id)),"
        + metrics_ctes("fm", "with_loc", "file_id", "code")
        + """,
per_file AS (SELECT src.file_id, (SELECT count(*) FROM fns WHERE fns.file_id = src.file_id)::INTEGER
  AS functionCount, (SELECT count(*) FROM issues WHERE issues.file_id = src.file_id)::INTEGER AS issueCount
  FROM src)"""
    )


HISTORY = history_sql(f"{CODE},{history_ctes()}", "JOIN per_file USING (file_id)")
LATEST = (
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, "
    "arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value "
    "FROM events GROUP BY user_id"
)
CHANGES = (
    "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, "
    "lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) "
    "WHERE prev IS DISTINCT FROM event_type"
)


def code(ctes: str, select: str) -> str:
    return W(f"{CODE},{ctes}", select)


def docs(ctes: str, select: str) -> str:
    return W(f"{DOCS},{ctes}" if ctes else DOCS, select)


def kinds_sql() -> str:
    cleaned = f"c AS (SELECT file_id, language, {clean_sql('code')} AS clean FROM src)"
    rows = [
        f"SELECT file_id, '{k}' AS kind, {n_of('clean', p)}::INTEGER AS n FROM c WHERE language {op} 'python'"
        for op, group in (("=", PY_KINDS), ("<>", JS_KINDS))
        for k, p in group.items()
    ]
    return code(cleaned, " UNION ALL ".join(rows))


def limit_sql(default: int) -> str:
    number = r"try_cast(regexp_extract(raw, '^\s*([+-]?[0-9]+)', 1) AS HUGEINT)"
    kept = f"CASE WHEN {number} IS NOT NULL THEN least(2147483647, greatest(-2147483647, {number})) END"
    return f"coalesce(nullif({kept}, 0), {default})::INTEGER"


_tokens_docs = f"""c AS (SELECT file_id, language, {clean_sql("code")} AS clean FROM src),
t AS (SELECT file_id, language, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS token
  FROM (SELECT file_id, language, regexp_extract_all(clean, {q(TOKEN + QUOTED)}) AS ts FROM c))"""
TOKEN_CLASS = (
    f"CASE WHEN (language = 'python' AND list_contains({PY_OPS}, token)) OR "
    f"(language <> 'python' AND list_contains({JS_OPS}, token)) THEN 'operator' "
    "WHEN regexp_matches(token, '^[a-zA-Z_$0-9]') THEN 'operand' ELSE 'ignored' END"
)
_neighbours = (
    DUP.split("dups AS")[0].strip().rstrip(",")
    + """,
nb AS (SELECT a.file_id, a.ord AS i, len(list_intersect(a.ws, b.ws)) AS shared,
  len(list_distinct(list_concat(a.ws, b.ws))) AS combined
  FROM wsets a JOIN wsets b ON a.file_id = b.file_id AND b.ord = a.ord + 1)"""
)
_spans_select = "SELECT file_id, ord, name, startLine, endLine, loc FROM fns WHERE language {} 'python'"
_js_raw = (
    "SELECT file_id, pattern::INTEGER AS pattern, seq, name, "
    f"array_to_string({PARAMS_JS}, '|') AS params, startLine FROM js_all"
)
_py_raw = f"SELECT file_id, seq, name, array_to_string({PARAMS_PY}, '|') AS params, startLine, indent FROM py"

ORACLES: dict[str, str] = {
    "src_code_files": """WITH raw AS (SELECT conv_id || '-' || turn AS file_id,
  CASE WHEN role = 'user' THEN 'c' || conv_id || '.py' END AS filename,
  CASE WHEN turn % 5 <> 4 THEN text END AS code FROM conversations)
SELECT file_id, coalesce(filename, 'untitled.js') AS filename, code || chr(10) AS code, '' AS error
FROM raw WHERE code IS NOT NULL UNION ALL
SELECT file_id, coalesce(filename, ''), '', 'missing field: code' FROM raw WHERE code IS NULL""",
    "page_is_file": W(
        CODE,
        f"SELECT kind, page_id, shown IS NOT NULL OR regexp_matches({PATH}, '^/[^/]+/[^/]+/blob/') AS is_file "
        f"FROM ({PAGES_UNION})",
    ),
    "page_repo_parts": W(
        CODE,
        "SELECT kind, page_id, CASE WHEN len(p) >= 3 THEN p[2] ELSE '' END AS owner, "
        "CASE WHEN len(p) >= 3 THEN p[3] ELSE '' END AS repo FROM (SELECT kind, page_id, "
        f"string_split({PATH}, '/') AS p FROM ({PAGES_UNION}))",
    ),
    "page_file_name": W(
        CODE,
        f"SELECT kind, page_id, coalesce(shown, string_split({PATH}, '/')[-1]) AS filename FROM ({PAGES_UNION})",
    ),
    "page_code_text": W(
        CODE,
        "SELECT 'web' AS kind, page_id, '' AS code FROM pages UNION ALL SELECT 'code', file_id, code FROM src",
    ),
    "pages_to_files": code(
        file_metrics(),
        "SELECT file_id, filename, fm.loc, cc AS cyclomaticComplexity FROM src JOIN fm USING (file_id)",
    ),
    "analyzable_gate": docs(
        "", "SELECT file_id, filename, language FROM src WHERE regexp_matches(code, '[^ \\t\\n]')"
    ),
    "language_detect": docs("", "SELECT file_id, filename, language FROM all_docs"),
    "unsupported_split": docs(
        "",
        "SELECT file_id, 'Unsupported language' AS error, language FROM all_docs WHERE language = 'unknown'",
    ),
    "line_split": docs(LINES, "SELECT file_id, line, text FROM lines"),
    "line_class": f"WITH d AS (WITH {DOCS},{LINES} SELECT file_id, line, line_class FROM labelled), "
    f"c AS (WITH {CODE},{LINES} SELECT file_id, line, line_class FROM labelled) "
    "SELECT file_id, line_class, count(*) AS n, sum(line)::BIGINT AS line_sum "
    "FROM (SELECT * FROM d UNION ALL SELECT * FROM c) GROUP BY 1, 2",
    "line_counts": code(LINES, "SELECT file_id, loc, sloc, blankLines, commentLines FROM counts"),
    "strip_noise": docs("", f"SELECT file_id, {clean_sql('code')} AS clean FROM src"),
    "token_extract": code(_tokens_docs, "SELECT file_id, pos::INTEGER AS pos, token FROM t"),
    "token_class": docs(
        _tokens_docs, f"SELECT file_id, pos::INTEGER AS pos, token, {TOKEN_CLASS} AS token_class FROM t"
    ),
    "decision_counts": kinds_sql(),
    "cyclomatic": docs(
        f"c AS (SELECT file_id, language, {clean_sql('code')} AS clean FROM src)",
        f"SELECT file_id, ({cc_sql('clean')})::INTEGER AS cc FROM c",
    ),
    "halstead": docs(file_metrics(), f"SELECT file_id, {HALSTEAD} FROM fm"),
    "maintainability": docs(file_metrics(), "SELECT file_id, mi AS maintainabilityIndex FROM fm"),
    "cc_level": code(
        file_metrics(),
        f"SELECT file_id, {cc_band('cc')} AS label, {cc_band('cc', 2)} AS color, "
        f"({cc_band('cc', 3)})::INTEGER AS level FROM fm",
    ),
    "mi_level": docs(
        file_metrics(),
        f"SELECT file_id, {mi_band('mi')} AS label, {mi_band('mi', 2)} AS color, "
        f"({mi_band('mi', 3)})::INTEGER AS level FROM fm",
    ),
    "file_summary": docs(file_metrics(), SUMMARY),
    "file_summary_service": code(file_metrics(True), SUMMARY),
    "case_count": code(CASES, "SELECT file_id, language, caseCount FROM cased"),
    "token_freq": code(
        _tokens_docs,
        f"SELECT * FROM (SELECT file_id, {TOKEN_CLASS} AS token_class, token, count(*) AS n FROM t "
        "GROUP BY 1, 2, 3) WHERE token_class <> 'ignored'",
    ),
    "token_totals": docs(
        file_metrics(),
        "SELECT file_id, uniqueOperators, uniqueOperands, totalOperators, totalOperands FROM fm",
    ),
    "functions_js": code(function_ctes(), _js_raw),
    "functions_dedupe": code(
        function_ctes(), "SELECT file_id, name, startLine, pattern::INTEGER AS pattern, seq FROM js_first"
    ),
    "functions_py": code(function_ctes(), _py_raw),
    "functions_py_line_anchor": code(function_ctes(py_pattern=PY_LINE_PATTERN), _py_raw),
    "function_end_brace": code(function_ctes(), _spans_select.format("<>")),
    "function_end_indent": code(function_ctes(), _spans_select.format("=")),
    "function_body": code(function_ctes(), "SELECT file_id, ord, name, body FROM fns"),
    "params_js": code(
        function_ctes(), f"SELECT file_id, ord, {JOIN_PARAMS}, paramCount FROM fns WHERE language <> 'python'"
    ),
    "params_py": code(
        function_ctes(), f"SELECT file_id, ord, {JOIN_PARAMS}, paramCount FROM fns WHERE language = 'python'"
    ),
    "nesting_brace": code(
        measured_ctes(), "SELECT file_id, ord, nesting AS maxNestingDepth FROM fx WHERE language <> 'python'"
    ),
    "nesting_indent": code(
        measured_ctes(), "SELECT file_id, ord, nesting AS maxNestingDepth FROM fx WHERE language = 'python'"
    ),
    "return_count": code(measured_ctes(), "SELECT file_id, ord, returns FROM fx"),
    "functions_all": code(measured_ctes(), FUNCTIONS),
    "functions_all_service": code(measured_ctes(True), FUNCTIONS),
    "functions_ranked": code(
        measured_ctes(),
        "SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY cc DESC, ord))::INTEGER AS rank, "
        "ord, name, startLine, cc AS cyclomaticComplexity FROM fx",
    ),
    "file_max_cc": code(
        measured_ctes(),
        "SELECT src.file_id, greatest(1, coalesce(max(cc), 1))::INTEGER AS maxComplexity "
        "FROM src LEFT JOIN fx ON fx.file_id = src.file_id GROUP BY 1",
    ),
    "dup_logic_pairs": code(
        f"{function_ctes()},{DUP}", "SELECT file_id, i, j, first, second, percent FROM pairs"
    ),
    "dup_logic_pairs_spread": code(
        f"{function_ctes()},{DUP}", "SELECT file_id, i, j, first, second, percent FROM pairs"
    ),
    "token_jaccard": code(
        f"{function_ctes()},{_neighbours}",
        f"SELECT file_id, i, {heat6('shared::DOUBLE / combined')} AS similarity_millionths FROM nb",
    ),
    "set_intersect_union": code(
        f"{function_ctes()},{_neighbours}",
        "SELECT file_id, i, shared::INTEGER AS shared, combined::INTEGER AS combined FROM nb",
    ),
    "heat_intensity": code(
        measured_ctes(),
        f"SELECT file_id, ord, name, cc AS cyclomaticComplexity, {heat6('heat')} AS heatIntensity_millionths FROM fx",
    ),
    "heatmap_regions": code(
        measured_ctes(),
        f"SELECT file_id, ord, name, startLine, endLine, {heat6('heat')} AS intensity_millionths, "
        f"cc AS complexity, {cc_band('cc', 2)} AS color FROM fx",
    ),
    "heat_lines": code(f"{measured_ctes()},{HEAT_LINES}", "SELECT file_id, ord, line, color FROM hl"),
    "heat_overlay": code(
        f"{measured_ctes()},{HEAT_LINES},{OVERLAY}",
        f"SELECT file_id, line, name, color, {heat6('0.08::DOUBLE + heat * 0.18::DOUBLE')} AS alpha_millionths FROM ov",
    ),
    "heat_color": code(
        f"{measured_ctes()},{HEAT_LINES},{OVERLAY}",
        f"SELECT file_id, line, {rgb(0)} AS r, {rgb(1)} AS g, {rgb(2)} AS b FROM ov",
    ),
    "badge_rows": code(
        measured_ctes(),
        f"SELECT file_id, startLine, name, 'CC: ' || cc AS badge, {cc_band('cc', 2)} AS color, label FROM "
        f"(SELECT *, first_value({cc_band('cc')}) OVER (PARTITION BY file_id, name ORDER BY ord) AS label, "
        "row_number() OVER (PARTITION BY file_id, startLine ORDER BY ord DESC) AS rn FROM fx) WHERE rn = 1",
    ),
    "lint_large_switch": code(CASES, f"SELECT file_id, {SWITCH_ISSUE} FROM cased WHERE caseCount > 10"),
    "lint_duplicate": code(f"{function_ctes()},{DUP}", f"SELECT file_id, i, j, {DUP_ISSUE} FROM pairs"),
    "lint_all": code(issues_ctes(), "SELECT * FROM issues"),
    "lint_all_service": code(issues_ctes(True), "SELECT * FROM issues"),
    "lint_all_custom_limits": code(
        issues_ctes(True, {"loc": 30, "nesting": 2, "params": 4, "cc": 8}), "SELECT * FROM issues"
    ),
    "lint_all_core_limits": code(
        issues_ctes(False, {"loc": 30, "nesting": 3, "params": 5, "cc": 2147483647}),
        "SELECT * FROM issues",
    ),
    "refactor_all": code(f"{measured_ctes()},{advice_cte()}", "SELECT * FROM advice"),
    "refactor_all_service": code(f"{measured_ctes(True)},{advice_cte(True)}", "SELECT * FROM advice"),
    "issue_message": code(
        f"{issues_ctes()},{advice_cte()}",
        "SELECT file_id, 'issue' AS kind, issue_ord AS ord, message AS text FROM issues UNION ALL "
        "SELECT file_id, 'advice', ord, description FROM advice",
    ),
    "thresholds_resolve": f"""WITH r AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'none'
  WHEN 1 THEN ' ' || p_size || ' lines' WHEN 2 THEN '0' WHEN 3 THEN
  CASE WHEN p_size % 2 = 0 THEN '' ELSE '99999999' || p_size || 'x' END ELSE (-p_size)::VARCHAR END AS raw FROM part)
SELECT p_partkey, {limit_sql(50)} AS max_loc, {limit_sql(3)} AS max_nesting, {limit_sql(5)} AS max_params,
  {limit_sql(10)} AS max_cc FROM r""",
    "display_attrs": code(
        f"{issues_ctes()},{advice_cte()}",
        "SELECT file_id, 'icon' AS kind, issue_ord AS ord, CASE severity WHEN 'critical' THEN '⛔' WHEN 'warning' THEN '⚠️' ELSE 'ℹ️' END AS shown "
        "FROM issues UNION ALL "
        "SELECT file_id, 'color', ord, CASE priority WHEN 'high' THEN '#f85149' ELSE '#d29922' END FROM advice "
        "UNION ALL SELECT file_id, 'label', ord, filename || ' (' || language || ')/L' || startLine || ' | ' || "
        "loc || ' LOC | ' || paramCount || 'p' FROM fx UNION ALL "
        "SELECT file_id, 'counts', 0, CASE WHEN EXISTS (FROM issues WHERE issues.file_id = src.file_id) THEN "
        "'#d29922' ELSE '#3fb950' END || '/' || CASE WHEN EXISTS (FROM advice WHERE advice.file_id = src.file_id) "
        "THEN '#58a6ff' ELSE '#3fb950' END FROM src",
    ),
    "file_counts": code(
        f"{issues_ctes()},{advice_cte()}",
        "SELECT file_id, (SELECT count(*) FROM fns WHERE fns.file_id = src.file_id)::INTEGER AS functionCount, "
        "(SELECT count(*) FROM issues WHERE issues.file_id = src.file_id)::INTEGER AS issueCount, "
        "(SELECT count(*) FROM advice WHERE advice.file_id = src.file_id)::INTEGER AS suggestionCount FROM src",
    ),
    "analysis_result": code(analysis_sql().removeprefix("WITH "), "").rstrip(),
    "analysis_result_service": code(analysis_sql(True).removeprefix("WITH "), "").rstrip(),
    "history_append": HISTORY,
    "history_top50": f"{HISTORY} ORDER BY timestamp DESC, id LIMIT 50",
    "latest_analysis": LATEST,
    "current_or_last": "SELECT user_id, coalesce(arg_max(value, (ts, event_id)) FILTER (event_type = 'view'), "
    "arg_max(value, (ts, event_id))) AS value, count(*) FILTER (event_type = 'view') > 0 AS is_current "
    "FROM events GROUP BY user_id",
    "change_only": CHANGES,
    "stream_analyze": history_sql(
        f"{DOCS},{history_ctes()}", "JOIN per_file USING (file_id)"
    ),
    "stream_latest": LATEST,
    "stream_change_only": CHANGES,
}
for _rule, _name in {
    "length": "lint_function_length", "nesting": "lint_nesting", "params": "lint_params",
    "returns": "lint_returns", "complexity": "lint_complexity",
}.items():
    ORACLES[_name] = code(
        measured_ctes(), f"SELECT file_id, ord, {ISSUE_COLUMNS} FROM ({rule_sql(_rule)})"
    )
for _rule in ("decompose", "param_object", "extract", "flatten"):
    ORACLES[f"refactor_{_rule}"] = code(
        measured_ctes(), f"SELECT file_id, ord, {ADVICE_COLUMNS} FROM ({suggestion_sql(_rule)})"
    )


def _level_json(band_of, x: str) -> str:
    return f"{{'label': {band_of(x)}, 'color': {band_of(x, 2)}, 'level': ({band_of(x, 3)})::INTEGER}}"


_halstead_json = "{" + ", ".join(f"'{h.strip()}': {h.strip()}" for h in HALSTEAD.split(",")) + "}"
_issue_json = "'type': type, 'rule': rule, 'message': message, 'line': line, 'severity': severity"
JSON_RESULT = code(
    issues_ctes()
    + ","
    + advice_cte()
    + ",with_loc AS (SELECT src.*, counts.loc FROM src JOIN counts USING (file_id)),"
    + metrics_ctes("fm", "with_loc", "file_id", "code")
    + f""",
jf AS (SELECT file_id, count(*)::INTEGER AS n, list({{'name': name, 'startLine': startLine, 'endLine': endLine,
  'loc': loc, 'params': params, 'paramCount': paramCount, 'cyclomaticComplexity': cc,
  'complexityLevel': {_level_json(cc_band, "cc")}, 'halstead': {_halstead_json},
  'maintainabilityIndex': mi, 'maintainabilityLevel': {_level_json(mi_band, "mi")},
  'maxNestingDepth': nesting, 'heatIntensity': heat}} ORDER BY ord) AS functions,
  list({{'name': name, 'startLine': startLine, 'endLine': endLine, 'intensity': heat, 'complexity': cc,
  'color': {cc_band("cc", 2)}}} ORDER BY ord) AS heatmap FROM fx GROUP BY file_id),
ji AS (SELECT file_id, list(CASE WHEN endLine = 0 THEN to_json({{{_issue_json}}})
  ELSE to_json({{{_issue_json}, 'endLine': endLine}}) END ORDER BY issue_ord) AS issues_list FROM issues GROUP BY file_id),
ja AS (SELECT file_id, list({{{", ".join(f"'{c.strip()}': {c.strip()}" for c in ADVICE_COLUMNS.split(","))}}}
  ORDER BY ord) AS advice_list FROM advice GROUP BY file_id)""",
    f"""SELECT file_id, to_json({{'language': language, 'filename': filename, 'summary': {{'loc': counts.loc,
  'sloc': sloc, 'blankLines': blankLines, 'commentLines': commentLines, 'functionCount': coalesce(n, 0)::INTEGER,
  'cyclomaticComplexity': cc, 'complexityLevel': {_level_json(cc_band, "cc")}, 'maintainabilityIndex': mi,
  'maintainabilityLevel': {_level_json(mi_band, "mi")}, 'halstead': {_halstead_json}}},
  'functions': coalesce(functions, []), 'linterIssues': coalesce(issues_list, []),
  'refactorSuggestions': coalesce(advice_list, []), 'heatmap': coalesce(heatmap, [])}})::VARCHAR AS result
  FROM src JOIN counts USING (file_id) JOIN fm USING (file_id) LEFT JOIN jf USING (file_id)
  LEFT JOIN ji USING (file_id) LEFT JOIN ja USING (file_id)""",
)
ORACLES["result_json"] = JSON_RESULT
