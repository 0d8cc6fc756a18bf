"""Lint issues and refactoring suggestions as array expressions."""

from __future__ import annotations

from collections.abc import Mapping

from . import sqltext as F
from .sqltext import Expr
from . import fixed
from .arrays import empty, first_of_runs
from .dialect import CORE, Dialect
from .text import JS, PY, by_language, count_of

ISSUE_DDL = (
    "struct<type:string,rule:string,message:string,line:int,severity:string,endLine:int>"
)
SUGGESTION_DDL = (
    "struct<function:string,line:int,type:string,priority:string,title:string,"
    "description:string,pattern:string>"
)

_TOP = 2**31 - 1


def resolve_limit(raw: Expr, name: str) -> Expr:
    """A user's limit: its leading whole number, or the default if none or zero.

    A number beyond the range of a count is the largest one, which is as good.
    """
    sign, digits = (F.regexp_extract(raw.cast("string"), r"^\s*([+-]?)0*([0-9]+)", i) for i in (1, 2))
    size = F.when(F.length(digits) > 10, F.lit(_TOP)).otherwise(
        F.least(digits.try_cast("bigint"), F.lit(_TOP))
    )
    size = F.when(digits != "", size)  # least() would pass over a null
    number = F.when(sign == "-", size * -1).otherwise(size).cast("int")
    return F.coalesce(F.nullif(number, F.lit(0)), F.lit(fixed.DEFAULT_LIMITS[name]))


def resolve_limits(limits: Mapping[str, object] | None) -> dict[str, Expr]:
    """All limits; given ones are read as a user writes them, None is the default."""
    given = dict(limits or {})
    if unknown := set(given) - set(fixed.DEFAULT_LIMITS):
        raise ValueError(f"unknown limits: {sorted(unknown)}")
    return {
        k: F.lit(default) if given.get(k) is None else resolve_limit(F.lit(str(given[k])), k)
        for k, default in fixed.DEFAULT_LIMITS.items()
    }


def _text(*parts: object) -> Expr:
    return F.concat(
        *(p.cast("string") if isinstance(p, Expr) else F.lit(p) for p in parts)
    )


def _issue(
    kind: str, rule: str, message: Expr, line: Expr, severity: Expr, end: Expr | None = None
) -> Expr:
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(rule).alias("rule"),
        message.alias("message"),
        line.alias("line"),
        severity.alias("severity"),
        (F.lit(None).cast("int") if end is None else end).alias("endLine"),
    )


def _grade(value: Expr, critical_above: int) -> Expr:
    return F.when(value > critical_above, "critical").otherwise("warning")


def counted_params(f: Expr, d: Dialect = CORE) -> Expr:
    """Parameters as the rules count them; the service skips self and cls again."""
    if d.is_core:
        return F.size(f["params"])
    return F.size(F.filter(f["params"], lambda p: ~p.isin("self", "cls")))


# -- lint ---------------------------------------------------------------------
def lint_function_length(f: Expr, limits: Mapping[str, Expr], d: Dialect = CORE) -> Expr:
    return F.when(
        f["loc"] > limits["loc"],
        _issue(
            "warning",
            "max-function-length",
            _text("Function '", f["name"], "' is ", f["loc"], " lines long (max ", limits["loc"], ")"),
            f["startLine"],
            _grade(f["loc"], fixed.CRITICAL_LOC),
            f["endLine"] if d.is_core else None,
        ),
    )


def lint_nesting(f: Expr, limits: Mapping[str, Expr], d: Dialect = CORE) -> Expr:
    depth = f["maxNestingDepth"]
    return F.when(
        depth > limits["nesting"],
        _issue(
            "warning",
            "max-nesting-depth",
            _text(
                "Function '", f["name"], "' has nesting depth of ", depth,
                " (max ", limits["nesting"], ")",
            ),
            f["startLine"],
            _grade(depth, fixed.CRITICAL_NESTING),
        ),
    )


def lint_params(f: Expr, limits: Mapping[str, Expr], d: Dialect = CORE) -> Expr:
    n = counted_params(f, d)
    return F.when(
        n > limits["params"],
        _issue(
            "warning",
            "max-params",
            _text("Function '", f["name"], "' has ", n, " parameters (max ", limits["params"], ")"),
            f["startLine"],
            F.lit("warning"),
        ),
    )


def lint_returns(f: Expr, limits: Mapping[str, Expr], d: Dialect = CORE) -> Expr:
    advice = " — consider simplifying" if d.is_core else ""
    return F.when(
        f["returns"] > fixed.MAX_RETURNS,
        _issue(
            "info",
            "multiple-returns",
            _text("Function '", f["name"], "' has ", f["returns"], " return statements" + advice),
            f["startLine"],
            F.lit("info"),
        ),
    )


def lint_complexity(f: Expr, limits: Mapping[str, Expr], d: Dialect = CORE) -> Expr:
    cc = f["cyclomaticComplexity"]
    return F.when(
        cc > limits["cc"],
        _issue(
            "warning",
            "high-complexity",
            _text(
                "Function '", f["name"], "' has cyclomatic complexity of ", cc,
                " (threshold: ", limits["cc"], ")",
            ),
            f["startLine"],
            _grade(cc, fixed.CRITICAL_CC),
        ),
    )


FUNCTION_RULES = (lint_function_length, lint_nesting, lint_params, lint_returns, lint_complexity)


def function_issues(fns: Expr, limits: Mapping[str, Expr], d: Dialect = CORE) -> Expr:
    """Per-function findings in order: function by function, rule by rule."""
    return F.flatten(
        F.transform(
            fns,
            lambda f: F.filter(
                F.array(*(rule(f, limits, d) for rule in FUNCTION_RULES)),
                lambda x: x.is_not_null(),
            ),
        )
    )


def has_switch(code: Expr, family: str, d: Dialect = CORE) -> Expr:
    if family == PY:
        return F.regexp_like(code, F.lit(rf"match{d.s}++{d.w}++{d.s}*+:"))
    return F.regexp_like(code, F.lit(rf"switch{d.s}*+\([^)]*+\){d.s}*+\{{"))


def case_count_family(code: Expr, family: str, d: Dialect = CORE) -> Expr:
    pattern = rf"{d.line_start}{d.s}*+case{d.s}++" if family == PY else d.words("case")
    return F.when(has_switch(code, family, d), count_of(code, pattern)).otherwise(F.lit(0))


def case_count(code: Expr, lang: Expr, d: Dialect = CORE) -> Expr:
    """Occurrences of ``case`` when the file holds a switch, else 0."""
    return by_language(lang, case_count_family(code, PY, d), case_count_family(code, JS, d))


def switch_issues(cases: Expr) -> Expr:
    """Zero or one issue per file."""
    issue = _issue(
        "warning",
        "large-switch",
        _text(
            "Large switch/match block with ", cases,
            " cases — consider using a lookup table or strategy pattern",
        ),
        F.lit(1),
        F.lit("warning"),
    )
    return F.when(cases > fixed.MAX_CASES, F.array(issue)).otherwise(empty(ISSUE_DDL))


def duplicate_issue(pair: Expr) -> Expr:
    return _issue(
        "info",
        "duplicate-logic",
        _text(
            "Functions '", pair["first"], "' and '", pair["second"], "' share ",
            pair["percent"], "% similar structure — consider extracting common logic",
        ),
        pair["line"],
        F.lit("info"),
    )


# -- refactoring --------------------------------------------------------------
def _suggestion(
    f: Expr, kind: str, priority: str, title: str, description: Expr, pattern: Expr
) -> Expr:
    return F.struct(
        f["name"].alias("function"),
        f["startLine"].alias("line"),
        F.lit(kind).alias("type"),
        F.lit(priority).alias("priority"),
        F.lit(title).alias("title"),
        description.alias("description"),
        pattern.alias("pattern"),
    )


def refactor_decompose(f: Expr, lang: Expr, d: Dialect = CORE) -> Expr:
    cc = f["cyclomaticComplexity"]
    tail = " suggests multiple responsibilities." if d.is_core else "."
    return F.when(
        cc > fixed.DECOMPOSE_CC,
        _suggestion(
            f,
            "decompose",
            "high",
            "Decompose Complex Function",
            _text("Split '", f["name"], "' into smaller sub-functions. CC=", cc, tail),
            F.lit("Extract Method"),
        ),
    )


def refactor_param_object(f: Expr, lang: Expr, d: Dialect = CORE) -> Expr:
    n = counted_params(f, d)
    tail = " parameters with a " + (
        "configuration object/dataclass." if d.is_core else "config object."
    )
    return F.when(
        n > fixed.DEFAULT_LIMITS["params"],
        _suggestion(
            f,
            "parameter-object",
            "medium",
            "Use Parameter Object",
            _text("Replace ", n, tail),
            F.when(lang == "python", "Use @dataclass").otherwise("Use Options Object"),
        ),
    )


def refactor_extract(f: Expr, lang: Expr, d: Dialect = CORE) -> Expr:
    tail = (
        " LOC is too long. Identify logical blocks and extract them into named functions."
        if d.is_core
        else " LOC — extract logical blocks into named functions."
    )
    return F.when(
        f["loc"] > fixed.DEFAULT_LIMITS["loc"],
        _suggestion(
            f,
            "extract-method",
            "high",
            "Extract Methods",
            _text(f["loc"], tail),
            F.lit("Extract Method + Single Responsibility"),
        ),
    )


def refactor_flatten(f: Expr, lang: Expr, d: Dialect = CORE) -> Expr:
    depth = f["maxNestingDepth"]
    return F.when(
        depth > fixed.DEFAULT_LIMITS["nesting"],
        _suggestion(
            f,
            "flatten",
            "medium",
            "Reduce Nesting",
            _text(
                "Nesting depth of ", depth,
                ". Use early returns, guard clauses, or extract nested blocks.",
            ),
            F.lit("Guard Clause + Early Return"),
        ),
    )


def refactor_rules(d: Dialect = CORE):
    rules = (refactor_decompose, refactor_param_object, refactor_extract)
    return (*rules, refactor_flatten) if d.is_core else rules


def suggestions(fns: Expr, lang: Expr, d: Dialect = CORE) -> Expr:
    """All suggestions in order; core keeps the first per (function, type)."""
    raw = F.flatten(
        F.transform(
            fns,
            lambda f: F.filter(
                F.array(*(rule(f, lang, d) for rule in refactor_rules(d))),
                lambda x: x.is_not_null(),
            ),
        )
    )
    if not d.is_core:
        return raw
    keyed = F.transform(
        raw,
        lambda s, i: F.struct(s["function"].alias("f"), s["type"].alias("t"), i.alias("i"), s.alias("s")),
    )
    kept = first_of_runs(
        F.sort_array(keyed), lambda a, b: (a["f"] == b["f"]) & (a["t"] == b["t"])
    )
    ordered = F.sort_array(
        F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))
    )
    return F.transform(ordered, lambda x: x["s"])
