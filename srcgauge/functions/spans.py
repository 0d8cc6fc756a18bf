"""Finding functions in a file, without leaving the file's row.

A pattern runs once over the code and wraps every match in two control
characters. The newlines between the marks then give each match's line, and the
marked text gives name and parameters; both are linear in the file. End lines come from one ordered walk over braces (or indents) that holds
only the functions still open.
"""

from __future__ import annotations

from string import ascii_letters, digits, punctuation

from . import sqltext as F
from .sqltext import Expr
from . import fixed
from .arrays import empty, first_of_runs, group_runs, let, running_sums
from .dialect import CORE, Dialect
from .text import PY, ltrim_once, trim_space

OPEN, CLOSE = "\x01", "\x03"  # neither a word character nor white space


#: Opening parentheses in a row, without a closing one, from which on those that lead to
#: nothing are taken out before a search. Below it they are scanned at most so many times.
UNCLOSED_RUN = 64


def js_patterns(d: Dialect = CORE) -> list[str]:
    """Declaration, variable, call-like block and (core) arrow patterns.

    Group 1 is the name, group 2 the parameter text. Names start at a word
    start and are possessive, so long words cost one pass. A look-ahead at the first
    letter drops most positions before words are tried.
    """
    s, w = d.s, d.w
    params = r"\(([^)]*+)\)"
    patterns = [
        rf"(?=[af])(?:async{s}++)?function{s}++({w}++){s}*+{params}",
        rf"(?=[clv])(?:const|let|var){s}++({w}++){s}*+={s}*+(?:async{s}++)?(?:function{s}*+)?{params}{s}*+(?:=>)?",
        rf"(?={w})(?<!{w})({w}++){s}*+{params}{s}*+\{{",
    ]
    if d.is_core:
        patterns.append(rf"(?={w})(?:async{s}++|(?<!{w}))({w}++){s}*+={s}*+{params}{s}*+=>")
    return patterns


def py_pattern(d: Dialect = CORE, anchor: str = "reference") -> str:
    """A ``def`` line. Group 1 is the indent, 2 the name, 3 the parameter text.

    With the reference's anchor the indent swallows preceding blank lines;
    ``anchor="line"`` keeps it on the ``def`` line.
    """
    lead = r"[ \t]*+" if anchor == "line" else rf"{d.s}*+"
    # A def line begins with white space, async or def: other characters are
    # dropped by one table look-up before the look-behind.
    others = "".join(c for c in punctuation + digits + ascii_letters if c not in "ad[]\\^-&")
    return (
        rf"(?![{others}]){d.line_start}({lead})(?:async{d.s}++)?def{d.s}++({d.w}++){d.s}*+\(([^)]*+)\)"
    )


def params_js(text: Expr, d: Dialect = CORE) -> Expr:
    return F.filter(
        F.transform(F.split(text, ",", -1), lambda p: trim_space(p, d)), lambda p: p != ""
    )


def params_py(text: Expr, d: Dialect = CORE) -> Expr:
    """Names without annotation and default; ``self`` and ``cls`` dropped."""
    parts = F.transform(F.split(text, ",", -1), lambda p: trim_space(p, d))
    if not d.is_core:  # the service drops empties before the cut only
        parts = F.filter(parts, lambda p: p != "")
    names = F.transform(
        parts,
        lambda p: trim_space(F.substring_index(F.substring_index(p, ":", 1), "=", 1), d),
    )
    dropped = ["self", "cls"] + ([""] if d.is_core else [])
    return F.filter(names, lambda p: ~p.isin(*dropped))


def _found(code: Expr, pattern: str) -> Expr:
    """Matches in text order: array of struct(line, text). The code is unmarked."""
    marked = F.regexp_replace(code, pattern, f"{OPEN}$0{CLOSE}")

    def read(m: Expr) -> Expr:
        return let(F.split(m, OPEN, -1), of_parts)

    def of_parts(parts: Expr) -> Expr:
        # A match begins a part; its line is told by the newlines of the parts before.
        before = running_sums(F.transform(parts, lambda p: newlines(p).cast("bigint")))
        return let(
            before,
            lambda sums: F.transform(
                F.slice(parts, F.lit(2), F.size(parts)),
                lambda p, i: F.struct(
                    (F.get(sums, i + 1) + 1).cast("int").alias("line"),
                    F.substring_index(p, CLOSE, 1).alias("text"),
                ),
            ),
        )

    return let(
        marked,
        lambda m: F.when(F.contains(m, F.lit(OPEN)), read(m)).otherwise(
            empty("struct<line:int,text:string>")
        ),
    )


def newlines(text: Expr) -> Expr:
    """Number of newlines; counted in bytes, so no character is decoded."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def js_tails(d: Dialect = CORE) -> list[str]:
    """What has to follow the closing parenthesis, pattern by pattern."""
    return ["", "", rf"{d.s}*+\{{", *([rf"{d.s}*+=>"] if d.is_core else [])]


def searchable(code: Expr, tail: str) -> Expr:
    """The code without the opening parentheses that no match can hold, line by line as long.

    A parameter text ends at the next closing parenthesis, so whatever opens between two
    closing ones meets the same end. Where no tail follows that end, or none closes, every
    try would read on to it and fail, in time that grows with the square of their number.
    """

    def cut(parts: Expr) -> Expr:
        def keeps(i: Expr) -> Expr:
            closed = i < F.size(parts) - 1
            if not tail:
                return closed
            return closed & F.regexp_like(F.get(parts, i + 1), F.lit(f"^{tail}"))

        kept = F.transform(
            parts,
            lambda part, i: F.when(F.contains(part, "(") & ~keeps(i), F.translate(part, "(", "\x02"))
            .otherwise(part),
        )
        return F.array_join(kept, ")")

    return let(F.split(code, r"\)", -1), cut)


def has_unclosed_run(code: Expr) -> Expr:
    """Whether so many parentheses open in a row. Most files are told by the byte search
    alone: they hold fewer."""
    held = F.octet_length(F.substring_index(code, "(", UNCLOSED_RUN)) < F.octet_length(code)
    return held & F.regexp_like(code, F.lit(rf"(?:\([^()]*+){{{UNCLOSED_RUN}}}"))


def unmarked(code: Expr) -> Expr:
    """The code with the two marks, should they occur, as another control character."""
    taken = F.contains(code, OPEN) | F.contains(code, CLOSE)
    return F.when(taken, F.translate(code, OPEN + CLOSE, "\x02\x02")).otherwise(code)


def js_matches(code: Expr, d: Dialect = CORE) -> Expr:
    """All matches of all patterns: struct(start, name, pattern, seq, params)."""

    def of(x: Expr, k: int, pattern: str) -> Expr:
        plain = x["plain"]
        searched = F.when(x["run"], searchable(plain, js_tails(d)[k - 1])).otherwise(plain)
        return F.transform(
            _found(searched, pattern),
            lambda m, i: F.struct(
                m["line"].alias("start"),
                F.regexp_extract(m["text"], pattern, 1).alias("name"),
                F.lit(k).alias("pattern"),
                i.alias("seq"),
                F.regexp_extract(m["text"], pattern, 2).alias("params"),
            ),
        )

    return let(
        let(unmarked(code), _with_run),
        lambda x: F.concat(*(of(x, k, p) for k, p in enumerate(js_patterns(d), 1))),
    )


def _with_run(plain: Expr) -> Expr:
    return F.struct(plain.alias("plain"), has_unclosed_run(plain).alias("run"))


def js_deduped(code: Expr, d: Dialect = CORE) -> Expr:
    """First match per (start, name), sorted by start line."""
    return first_of_runs(
        F.sort_array(js_matches(code, d)),
        lambda a, b: (a["start"] == b["start"]) & (a["name"] == b["name"]),
    )


def py_matches(code: Expr, d: Dialect = CORE, anchor: str = "reference") -> Expr:
    """All defs in text order: struct(start, name, pattern, seq, params, base)."""
    pattern = py_pattern(d, anchor)
    searched = let(
        unmarked(code),
        lambda plain: F.when(has_unclosed_run(plain), searchable(plain, "")).otherwise(plain),
    )
    return F.transform(
        _found(searched, pattern),
        lambda m, i: F.struct(
            m["line"].alias("start"),
            F.regexp_extract(m["text"], pattern, 2).alias("name"),
            F.lit(1).alias("pattern"),
            i.alias("seq"),
            F.regexp_extract(m["text"], pattern, 3).alias("params"),
            F.length(F.regexp_extract(m["text"], pattern, 1)).alias("base"),
        ),
    )


def _end_text(key: Expr, end: Expr) -> Expr:
    """An end as text. A fold copies its state at every step, element by element; a
    text is copied as one block of bytes, so the ends found so far cost little."""
    return F.concat(key.cast("string"), F.lit(","), end.cast("string"), F.lit(";"))


def _ends_of(done: Expr, key: str) -> Expr:
    """Array of struct(key, end) from the texts of ``_end_text``."""
    return F.transform(
        F.filter(F.split(done, ";", -1), lambda t: t != ""),
        lambda t: F.struct(
            F.split_part(t, F.lit(","), F.lit(1)).cast("int").alias(key),
            F.split_part(t, F.lit(","), F.lit(2)).cast("int").alias("end"),
        ),
    )


def _brace_ends(code: Expr, lines: Expr, starts: Expr) -> Expr:
    """End line for every start line (sorted, distinct): array of int."""
    # Events sorted by (line, kind, at): a start precedes its line's braces.
    def braces_of(text: Expr, i: Expr) -> Expr:
        return F.transform(
            F.regexp_extract_all(text, F.lit("[{}]"), F.lit(0)),
            lambda c, j: F.struct(
                (i + 1).alias("line"),
                F.lit(1).alias("kind"),
                j.alias("at"),
                F.when(c == "{", 1).otherwise(-1).alias("step"),
            ),
        )

    # Lines without a brace are null here, and no pattern is run on them.
    braces = F.flatten(
        F.filter(
            F.transform(
                lines,
                lambda text, i: F.when(
                    F.contains(text, "{") | F.contains(text, "}"), braces_of(text, i)
                ),
            ),
            lambda found: found.is_not_null(),
        )
    )
    opens = F.transform(
        starts,
        lambda s: F.struct(
            s.alias("line"), F.lit(0).alias("kind"), F.lit(0).alias("at"), F.lit(0).alias("step")
        ),
    )
    entry = "struct<line:int,base:int,begun:boolean>"

    def state(depth: Expr, waiting: Expr, done: Expr) -> Expr:
        return F.struct(depth.alias("depth"), waiting.alias("open"), done.alias("done"))

    def brace(acc: Expr, e: Expr) -> Expr:
        depth = acc["depth"] + e["step"]
        begins = e["step"] == 1

        def closes(o: Expr) -> Expr:
            return (o["begun"] | begins) & (o["base"] == depth)

        def settle(waiting: Expr) -> Expr:
            kept = F.filter(waiting, lambda o: ~closes(o))
            kept = F.when(
                begins,
                F.transform(
                    kept,
                    lambda o: F.struct(
                        o["line"].alias("line"), o["base"].alias("base"), F.lit(True).alias("begun")
                    ),
                ),
            ).otherwise(kept)
            ended = F.transform(
                F.filter(waiting, closes), lambda o: _end_text(o["line"], e["line"])
            )
            return state(depth, kept, F.concat(acc["done"], F.array_join(ended, "")))

        return F.when(F.size(acc["open"]) == 0, state(depth, acc["open"], acc["done"])).otherwise(
            settle(acc["open"])
        )

    def step(acc: Expr, e: Expr) -> Expr:
        started = F.struct(
            e["line"].alias("line"), acc["depth"].alias("base"), F.lit(False).alias("begun")
        )
        return F.when(
            e["kind"] == 0,
            state(acc["depth"], F.concat(acc["open"], F.array(started)), acc["done"]),
        ).otherwise(brace(acc, e))

    total = newlines(code) + 1

    def finish(acc: Expr) -> Expr:
        rest = F.transform(
            acc["open"],
            lambda o: F.struct(
                o["line"].alias("line"),
                F.least(o["line"] - 1 + fixed.FALLBACK_LINES, total).alias("end"),
            ),
        )
        return F.transform(
            F.sort_array(F.concat(_ends_of(acc["done"], "line"), rest)), lambda x: x["end"]
        )

    return F.aggregate(
        F.sort_array(F.concat(opens, braces)),
        state(F.lit(0), empty(entry), F.lit("")),
        step,
        finish,
    )


def _indent_ends(lines: Expr, hits: Expr, d: Dialect) -> Expr:
    """End line for every def in text order: array of int."""
    # Events sorted by (line, kind): a line's indent closes before its def opens.
    indents = F.filter(
        F.transform(
            lines,
            lambda text, i: let(
                F.length(ltrim_once(text, d)),
                lambda bare: F.struct(
                    (i + 1).alias("line"),
                    F.lit(0).alias("kind"),
                    F.lit(-1).alias("id"),
                    F.when(bare > 0, F.length(text) - bare).alias("indent"),
                ),
            ),
        ),
        lambda e: e["indent"].is_not_null(),
    )
    opens = F.transform(
        hits,
        lambda h: F.struct(
            h["start"].alias("line"),
            F.lit(1).alias("kind"),
            h["seq"].alias("id"),
            h["base"].alias("indent"),
        ),
    )

    def state(waiting: Expr, done: Expr) -> Expr:
        return F.struct(waiting.alias("open"), done.alias("done"))

    def step(acc: Expr, e: Expr) -> Expr:
        entry = F.struct(e["id"].alias("id"), e["indent"].alias("base"))
        closed = F.transform(
            F.filter(acc["open"], lambda o: o["base"] >= e["indent"]),
            lambda o: _end_text(o["id"], e["line"] - 1),
        )
        return (
            F.when(
                e["kind"] == 1, state(F.concat(acc["open"], F.array(entry)), acc["done"])
            )
            .when(
                F.exists(acc["open"], lambda o: o["base"] >= e["indent"]),
                state(
                    F.filter(acc["open"], lambda o: o["base"] < e["indent"]),
                    F.concat(acc["done"], F.array_join(closed, "")),
                ),
            )
            .otherwise(acc)
        )

    def finish(acc: Expr) -> Expr:
        rest = F.transform(
            acc["open"], lambda o: F.struct(o["id"].alias("id"), F.size(lines).alias("end"))
        )
        return F.transform(
            F.sort_array(F.concat(_ends_of(acc["done"], "id"), rest)), lambda x: x["end"]
        )

    return F.aggregate(
        F.sort_array(F.concat(indents, opens)),
        state(empty("struct<id:int,base:int>"), F.lit("")),
        step,
        finish,
    )


REGION_DDL = (
    "struct<start:int,end:int,"
    "fns:array<struct<pattern:int,seq:int,name:string,params:array<string>>>>"
)


def _fn(hit: Expr, params: Expr) -> Expr:
    return F.struct(
        hit["pattern"].alias("pattern"),
        hit["seq"].alias("seq"),
        hit["name"].alias("name"),
        params.alias("params"),
    )


def js_regions(code: Expr, lines: Expr, d: Dialect = CORE) -> Expr:
    """Distinct start lines with end line and the functions that begin there.

    Functions of one start line share end and body, so a minified one-line file
    has one region however many functions it names.
    """

    def of(groups: Expr) -> Expr:
        starts = F.transform(groups, lambda g: F.get(g, F.lit(0))["start"])
        return F.zip_with(
            groups,
            _brace_ends(code, lines, starts),
            lambda g, end: F.struct(
                F.get(g, F.lit(0))["start"].alias("start"),
                end.alias("end"),
                F.transform(g, lambda h: _fn(h, params_js(h["params"], d))).alias("fns"),
            ),
        )

    return let(
        js_deduped(code, d),
        lambda hits: F.when(
            F.size(hits) > 0,
            let(group_runs(hits, lambda a, b: a["start"] == b["start"]), of),
        ).otherwise(empty(REGION_DDL)),
    )


def py_regions(
    code: Expr, lines: Expr, d: Dialect = CORE, anchor: str = "reference"
) -> Expr:
    """One region per def."""

    def of(hits: Expr) -> Expr:
        return F.zip_with(
            hits,
            _indent_ends(lines, hits, d),
            lambda h, end: F.struct(
                h["start"].alias("start"),
                end.alias("end"),
                F.array(_fn(h, params_py(h["params"], d))).alias("fns"),
            ),
        )

    return let(
        py_matches(code, d, anchor),
        lambda hits: F.when(F.size(hits) > 0, of(hits)).otherwise(empty(REGION_DDL)),
    )


def regions(
    code: Expr, lines: Expr, family: str, d: Dialect = CORE, anchor: str = "reference"
) -> Expr:
    return py_regions(code, lines, d, anchor) if family == PY else js_regions(code, lines, d)


def body_of(lines: Expr, start: Expr, end: Expr) -> Expr:
    return F.array_join(F.slice(lines, start, end - start + 1), "\n")


