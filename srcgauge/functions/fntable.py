"""The function table of one file as an array column, metrics included.

Functions lie inside each other, so their bodies hold a line as often as it is nested. The
lines are therefore measured once, in the pieces between the starts and ends of all
functions, and a body is told from its pieces. Where a comment or a string may go on
behind a piece, the bodies that hold it are measured as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from . import sqltext as F
from .sqltext import Expr
from . import metrics as M
from .arrays import let
from .dialect import CORE, Dialect
from .spans import body_of, regions
from .text import JS, PY, by_language, line_split, marks, strip_closed, strip_family

# What can be measured on a body. Asking for less keeps the plan shorter.
ALL = ("cc", "halstead", "nesting", "returns", "words", "body")
#: Asked for with these, the table also has ``whole``: complexity and Halstead metrics of the file.
WHOLE = "whole"


def sorted_words(body: Expr, d: Dialect) -> Expr:
    """Distinct words in order, so that equal sets are equal arrays."""
    return F.sort_array(M.distinct_words(body, d))


def _measures(body: Expr, family: str, d: Dialect, want: set[str]) -> Expr:
    def with_clean(clean: Expr) -> Expr:
        fields = []
        if "cc" in want:
            fields.append(M.cyclomatic_clean(clean, family, d).alias("cc"))
        if "halstead" in want:
            fields.append(M.halstead_clean(clean, family, d).alias("halstead"))
        if "nesting" in want:
            fields.append(M.nesting(body, family, d).alias("nesting"))
        if "returns" in want:
            fields.append(M.return_count(body, d).alias("returns"))
        if "words" in want:
            fields.append(sorted_words(body, d).alias("words"))
        if "body" in want:
            fields.append(body.alias("body"))
        return F.struct(*fields)

    if want & {"cc", "halstead"}:
        return let(strip_family(body, family, d), with_clean)
    return with_clean(body)


# -- pieces -------------------------------------------------------------------
def _pieces(lines: Expr, found: Expr) -> Expr:
    """The lines between the starts and ends of regions: struct(first, last) in order."""
    cuts = F.sort_array(
        F.array_distinct(
            F.concat(
                F.array(F.lit(1), F.size(lines) + 1),
                F.transform(found, lambda r: r["start"]),
                F.transform(found, lambda r: r["end"] + 1),
            )
        )
    )
    return let(
        cuts,
        lambda cs: F.transform(
            F.slice(cs, 1, F.size(cs) - 1),
            lambda c, i: F.struct(c.alias("first"), (F.get(cs, i + 1) - 1).alias("last")),
        ),
    )


def _ends_open(clean: Expr, d: Dialect) -> Expr:
    """Whether a decision may go on in the next line: after ``else`` or a question mark."""
    return F.when(
        F.contains(clean, "else") | F.contains(clean, "?"),
        let(
            F.rtrim(clean, d.space_chars),
            lambda bare: F.endswith(bare, F.lit("else")) | F.endswith(bare, F.lit("?")),
        ),
    ).otherwise(F.lit(False))


def _piece(text: Expr, family: str, d: Dialect, want: set[str]) -> Expr:
    """What a piece adds to the measures of the bodies that hold it."""

    def measured(x: Expr | None) -> Expr:
        fields = []
        if x is None:
            fields.append(F.lit(True).alias("closed"))
        else:
            clean = x["text"]
            closed = x["closed"] & ~_ends_open(clean, d)
            if family == PY:  # a token may be quoted so, which no rule strips there
                closed = closed & (marks(clean, "`") % 2 == 0)
            fields.append(closed.alias("closed"))
            if "cc" in want:
                fields.append((M.cyclomatic_clean(clean, family, d) - 1).alias("cc"))
            if "halstead" in want:
                tokens = M.operators_and_operands(M.token_extract(clean, d), family)
                counted = let(
                    tokens,
                    lambda t: F.struct(
                        F.array_distinct(t["ops"]).alias("ops"),
                        F.array_distinct(t["opnds"]).alias("opnds"),
                        F.size(t["ops"]).alias("t1"),
                        F.size(t["opnds"]).alias("t2"),
                    ),
                )
                fields.append(counted.alias("tokens"))
        if "nesting" in want:
            fields.append(M.nesting_part(text, family, d).alias("nesting"))
        if "returns" in want:
            fields.append(M.return_count(text, d).alias("returns"))
        if "words" in want:
            fields.append(M.distinct_words(text, d).alias("words"))
        return F.struct(*fields)

    if want & {"cc", "halstead"}:
        return let(strip_closed(text, family, d), measured)
    return measured(None)


def _joined(pieces: Expr, family: str, d: Dialect, want: set[str]) -> Expr:
    """The measures of closed pieces that follow one another."""

    def total(first: int, of: Callable[[Expr], Expr]) -> Expr:
        return F.aggregate(pieces, F.lit(first), lambda acc, x: acc + of(x))

    def distinct(kind: str) -> Expr:
        return F.array_distinct(F.flatten(F.transform(pieces, lambda x: x["tokens"][kind])))

    fields = []
    if "cc" in want:
        fields.append(total(1, lambda x: x["cc"]).alias("cc"))
    if "halstead" in want:
        counts = F.struct(
            F.size(distinct("ops")).alias("n1"),
            F.size(distinct("opnds")).alias("n2"),
            total(0, lambda x: x["tokens"]["t1"]).alias("t1"),
            total(0, lambda x: x["tokens"]["t2"]).alias("t2"),
        )
        fields.append(M.halstead_of(counts, d).alias("halstead"))
    if "nesting" in want:
        parts = F.transform(pieces, lambda x: x["nesting"])
        fields.append(M.nesting_of(parts, family).alias("nesting"))
    if "returns" in want:
        fields.append(total(0, lambda x: x["returns"]).alias("returns"))
    if "words" in want:
        # A text without a word has the empty one.
        words = F.array_distinct(F.flatten(F.transform(pieces, lambda x: x["words"])))
        held = let(
            F.array_remove(words, ""),
            lambda ws: F.when(F.size(ws) > 0, F.sort_array(ws)).otherwise(F.array("")),
        )
        fields.append(held.alias("words"))
    return F.struct(*fields)


def _all_closed(pieces: Expr) -> Expr:
    return F.forall(pieces, lambda x: x["closed"])


def _cut(lines: Expr, found: Expr, family: str, d: Dialect, want: set[str]) -> Expr:
    """struct(pieces, at): the measured pieces, and each line's piece."""
    return let(
        _pieces(lines, found),
        lambda ps: F.struct(
            F.transform(
                ps,
                lambda p: let(
                    body_of(lines, p["first"], p["last"]), lambda text: _piece(text, family, d, want)
                ),
            ).alias("pieces"),
            F.flatten(
                F.transform(ps, lambda p, i: F.array_repeat(i, p["last"] - p["first"] + 1))
            ).alias("at"),
        ),
    )


def _rows(
    region: Expr, lines: Expr, family: str, d: Dialect, want: set[str], cut: Expr | None
) -> Expr:
    start, end = region["start"], region["end"]
    loc = end - start + 1

    def of(m: Expr | None, mi: Expr | None = None) -> Expr:
        def row(f: Expr) -> Expr:
            fields = [
                f["pattern"].alias("pattern"),
                f["seq"].alias("seq"),
                f["name"].alias("name"),
                f["params"].alias("params"),
                start.alias("startLine"),
                end.alias("endLine"),
                loc.alias("loc"),
                F.size(f["params"]).alias("paramCount"),
            ]
            if "cc" in want:
                fields.append(m["cc"].alias("cyclomaticComplexity"))
                fields.append(M.cc_level(m["cc"]).alias("complexityLevel"))
            if "halstead" in want:
                fields.append(m["halstead"].alias("halstead"))
            if {"cc", "halstead"} <= want:
                fields.append(mi.alias("maintainabilityIndex"))
                fields.append(M.mi_level(mi).alias("maintainabilityLevel"))
            if "nesting" in want:
                fields.append(m["nesting"].alias("maxNestingDepth"))
            for k in ("returns", "words", "body"):
                if k in want:
                    fields.append(m[k].alias(k))
            return F.struct(*fields)

        return F.transform(region["fns"], row)

    def with_mi(m: Expr) -> Expr:
        if not {"cc", "halstead"} <= want:
            return of(m)
        mi = M.maintainability(m["halstead"]["volume"], m["cc"], loc, d)
        return let(F.struct(m.alias("m"), mi.alias("mi")), lambda x: of(x["m"], x["mi"]))

    if not want:
        return of(None)
    whole = let(body_of(lines, start, end), lambda body: _measures(body, family, d, want))
    if cut is None:
        return let(whole, with_mi)
    first = F.get(cut["at"], start - 1)
    held = F.when(
        end >= start,
        F.slice(cut["pieces"], first + 1, F.get(cut["at"], end - 1) - first + 1),
    ).otherwise(F.slice(cut["pieces"], 1, 0))
    measured = let(
        held,
        lambda ps: F.when(
            (F.size(ps) > 0) & _all_closed(ps), _joined(ps, family, d, want)
        ).otherwise(whole),
    )
    return let(measured, with_mi)


def _lines_are_cut(want: set[str]) -> bool:
    return bool(want - {WHOLE}) and "body" not in want


def _checked(want: Iterable[str]) -> set[str]:
    wanted = set(want)
    if unknown := wanted - {*ALL, WHOLE}:
        raise ValueError(f"unknown measures: {sorted(unknown)}")
    if WHOLE in wanted and (not {"cc", "halstead"} <= wanted or "body" in wanted):
        raise ValueError("the whole file goes with cc and halstead, and without body")
    return wanted


def steps(
    code: Expr,
    lang: Expr,
    d: Dialect = CORE,
    want: Iterable[str] = (),
    anchor: str = "reference",
) -> dict[str, Expr]:
    """The steps to the column ``fns``, each an expression over columns of steps before it.
    One expression would nest too deep for the analyzer. With ``whole`` among the wanted,
    the last one is the column ``whole``."""
    wanted = _checked(want)

    def found(family: str) -> Expr:
        return let(line_split(code), lambda lines: regions(code, lines, family, d, anchor))

    spans = by_language(lang, found(PY), found(JS))
    table = by_language(lang, *(_family_table(code, family, d, wanted) for family in (PY, JS)))
    return {
        "_regions": spans,
        "_table": table,
        "fns": _numbered(F.col("_table")["fns"], wanted),
        **({WHOLE: F.col("_table")[WHOLE]} if WHOLE in wanted else {}),
    }


def _whole(code: Expr, pieces: Expr, family: str, d: Dialect) -> Expr:
    """Complexity and Halstead metrics of a file: struct(cc, halstead)."""
    want = {"cc", "halstead"}
    return F.when(_all_closed(pieces), _joined(pieces, family, d, want)).otherwise(
        _measures(code, family, d, want)
    )


def _family_table(code: Expr, family: str, d: Dialect, want: set[str]) -> Expr:
    """struct(fns) or struct(fns, whole); the rows are in result order."""
    found, measured = F.col("_regions"), want - {WHOLE}

    def table(lines: Expr, cut: Expr | None) -> Expr:
        rows = F.transform(found, lambda r: _rows(r, lines, family, d, measured, cut))
        fields = [F.sort_array(F.flatten(rows)).alias("fns")]
        if WHOLE in want:
            fields.append(_whole(code, cut["pieces"], family, d).alias(WHOLE))
        return F.struct(*fields)

    def of(lines: Expr) -> Expr:
        if not _lines_are_cut(want):
            return table(lines, None)
        return let(_cut(lines, found, family, d, measured), lambda cut: table(lines, cut))

    return let(line_split(code), of)


def _numbered(table: Expr, wanted: set[str]) -> Expr:
    """All functions of a file, each with its ordinal ``ord``.

    The metrics of a region are computed once, for all functions that share it.
    ``heatIntensity`` is added when ``cc`` is wanted.
    """
    fields = _field_names(wanted)

    def finish(fns: Expr) -> Expr:
        top = F.lit(1)
        if "cc" in wanted:
            top = F.greatest(
                1, F.coalesce(F.array_max(F.transform(fns, lambda f: f["cyclomaticComplexity"])), 1)
            )

        def numbered(f: Expr, i: Expr, highest: Expr) -> Expr:
            out = [i.alias("ord"), *(f[k].alias(k) for k in fields)]
            if "cc" in wanted:
                out.append((f["cyclomaticComplexity"] / highest).alias("heatIntensity"))
            return F.struct(*out)

        return let(top, lambda t: F.transform(fns, lambda f, i: numbered(f, i, t)))

    return let(table, finish)


def _field_names(want: set[str]) -> list[str]:
    names = ["name", "params", "startLine", "endLine", "loc", "paramCount"]
    if "cc" in want:
        names += ["cyclomaticComplexity", "complexityLevel"]
    if "halstead" in want:
        names.append("halstead")
    if {"cc", "halstead"} <= want:
        names += ["maintainabilityIndex", "maintainabilityLevel"]
    if "nesting" in want:
        names.append("maxNestingDepth")
    return names + [k for k in ("returns", "words", "body") if k in want]


PUBLIC_FIELDS = (
    "name",
    "startLine",
    "endLine",
    "loc",
    "params",
    "paramCount",
    "cyclomaticComplexity",
    "complexityLevel",
    "halstead",
    "maintainabilityIndex",
    "maintainabilityLevel",
    "maxNestingDepth",
    "heatIntensity",
)


def public_function(f: Expr) -> Expr:
    return F.struct(*(f[k].alias(k) for k in PUBLIC_FIELDS))


def heat_region(f: Expr) -> Expr:
    return F.struct(
        f["name"].alias("name"),
        f["startLine"].alias("startLine"),
        f["endLine"].alias("endLine"),
        f["heatIntensity"].alias("intensity"),
        f["cyclomaticComplexity"].alias("complexity"),
        f["complexityLevel"]["color"].alias("color"),
    )
