"""Expressions on file names, lines and raw text."""

from __future__ import annotations

from collections.abc import Callable

from . import sqltext as F
from .sqltext import Expr
from . import fixed
from .arrays import let
from .dialect import CORE, Dialect

JS, PY = "brace", "indent"  # the two syntax families


def by_language(lang: Expr, python: Expr, braces: Expr) -> Expr:
    return F.when(lang == "python", python).otherwise(braces)


def language_detect(filename: Expr) -> Expr:
    """Language by the text after the last dot, in any case.

    Matched by pattern: Spark's ``lower`` first builds case tables for seconds.
    """

    def ends(*endings: str) -> Expr:
        return F.regexp_like(filename, rf"(?i)(?:\A|\.)(?:{'|'.join(endings)})\z")

    return (
        F.when(ends(*fixed.JAVASCRIPT_ENDINGS), "javascript")
        .when(ends(*fixed.TYPESCRIPT_ENDINGS), "typescript")
        .when(ends(*fixed.PYTHON_ENDINGS), "python")
        .otherwise("unknown")
    )


def trim_space(text: Expr, d: Dialect = CORE) -> Expr:
    return F.trim(text, d.space_chars)


def ltrim_space(text: Expr, d: Dialect = CORE) -> Expr:
    return F.ltrim(text, d.space_chars)


def ltrim_blanks(text: Expr) -> Expr:
    """Without leading blanks; much quicker than a trim of given characters."""
    return F.call("ltrim", text)


def ltrim_once(text: Expr, d: Dialect = CORE) -> Expr:
    """``ltrim_space`` for lines: most are led by nothing but blanks."""
    return let(
        ltrim_blanks(text),
        lambda bare: F.when(
            F.contains(F.lit(d.space_chars), F.left(bare, F.lit(1))), ltrim_space(bare, d)
        ).otherwise(bare),
    )


def line_split(code: Expr) -> Expr:
    return F.split(code, "\n", -1)


def line_class(line: Expr, lang: Expr, d: Dialect = CORE) -> Expr:
    """``blank``, ``comment`` or ``source`` for one line."""
    bare = ltrim_space(line, d)
    return (
        F.when(bare == "", "blank")
        .when((lang == "python") & bare.startswith("#"), "comment")
        .when(
            (lang != "python")
            & (bare.startswith("//") | bare.startswith("/*") | bare.startswith("*")),
            "comment",
        )
        .otherwise("source")
    )


def count_of(text: Expr, pattern: str, hint: str | None = None) -> Expr:
    """Number of matches. A text without the hint has none and is not searched."""
    found = F.regexp_count(text, F.lit(pattern))
    return F.when(F.contains(text, hint), found).otherwise(0) if hint else found


def line_total(code: Expr) -> Expr:
    return F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit(""))) + 1


def line_counts(code: Expr, lang: Expr, d: Dialect = CORE) -> Expr:
    """Struct loc, sloc, blankLines, commentLines.

    Counted with patterns that begin at a newline, so no array of lines is built.
    """
    lead = rf"\n[{d.inline_space}]*+"
    led = F.concat("\n", code)  # every line now follows a newline
    loc = line_total(code)
    blank = count_of(led, rf"{lead}(?![^\n])")
    comment = by_language(
        lang, count_of(led, rf"{lead}#"), count_of(led, rf"{lead}(?://|/\*|\*)")
    )
    counted = F.struct(loc.alias("loc"), blank.alias("blank"), comment.alias("comment"))
    return let(
        counted,
        lambda n: F.struct(
            n["loc"].alias("loc"),
            (n["loc"] - n["blank"] - n["comment"]).alias("sloc"),
            n["blank"].alias("blankLines"),
            n["comment"].alias("commentLines"),
        ),
    )


def strip_family(code: Expr, family: str, d: Dialect = CORE) -> Expr:
    """Remove comments and blank out string literals, rule after rule.

    A rule only runs on a text that holds its opening mark.
    """
    if family != PY:
        code = let(code, _block_comments)
    for mark, pattern, blank in _strip_rules(family, d):
        code = let(code, _rule(mark, pattern, blank))
    return code


def _strip_rules(family: str, d: Dialect) -> list[tuple[str, str, str]]:
    """Mark, pattern and what takes its place, in order; a block comment goes before."""
    if family == PY:
        rules = [
            ("'''", r"(?s)'''.*?'''", ""),
            ('"""', r'(?s)""".*?"""', ""),
            ("#", rf"#{d.rest_of_line}", ""),
        ]
    else:
        rules = [
            ("//", rf"//{d.rest_of_line}", ""),
            ("`", "`[^`]*+`", '""'),
        ]
    return [*rules, ("'", "'[^']*+'", '""'), ('"', '"[^"]*+"', '""')]


def strip_closed(code: Expr, family: str, d: Dialect = CORE) -> Expr:
    """``strip_family`` of whole lines, and whether no rule could go on behind them:
    struct(text, closed). Closed pieces that follow one another, joined by newlines, are
    stripped piece by piece as they are in one."""

    def state(text: Expr, closed: Expr) -> Expr:
        return F.struct(text.alias("text"), closed.alias("closed"))

    def step(found: Expr, mark: str, changed: Expr, closed: Callable[[Expr], Expr]) -> Expr:
        after = let(changed, lambda text: state(text, found["closed"] & closed(text)))
        return F.when(F.contains(found["text"], mark), after).otherwise(found)

    def rule(mark: str, pattern: str, blank: str) -> Callable[[Expr], Expr]:
        def of(found: Expr) -> Expr:
            text = found["text"]
            if len(mark) == 3:  # a mark that is left has no partner
                closed = lambda rest: ~F.contains(rest, mark)
            elif blank:  # every second mark ends a match
                closed = lambda _: marks(text, mark) % 2 == 0
            else:  # the rest of a line
                closed = lambda _: F.lit(True)
            return step(found, mark, F.regexp_replace(text, pattern, blank), closed)

        return of

    found = state(code, F.lit(True))
    if family != PY:
        found = let(
            found,
            lambda f: step(f, "/*", _block_comments(f["text"]), lambda rest: ~F.contains(rest, "/*")),
        )
    for mark, pattern, blank in _strip_rules(family, d):
        found = let(found, rule(mark, pattern, blank))
    return found


def marks(text: Expr, mark: str) -> Expr:
    """How often an ASCII character occurs; counted in bytes."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def _block_comments(text: Expr) -> Expr:
    """Searched up to the last closing mark only: behind it, every opening mark
    (path patterns in strings, say) would be followed to the end in vain."""
    tail = F.substring_index(text, "*/", -1)
    return F.when(
        F.contains(text, "/*") & F.contains(text, "*/"),
        let(
            tail,
            lambda rest: F.concat(
                F.regexp_replace(
                    F.left(text, F.length(text) - F.length(rest)), r"(?s)/\*.*?\*/", ""
                ),
                rest,
            ),
        ),
    ).otherwise(text)


def _rule(mark: str, pattern: str, blank: str) -> Callable[[Expr], Expr]:
    return lambda text: F.when(
        F.contains(text, mark), F.regexp_replace(text, pattern, blank)
    ).otherwise(text)


def strip_noise(code: Expr, lang: Expr, d: Dialect = CORE) -> Expr:
    return by_language(lang, strip_family(code, PY, d), strip_family(code, JS, d))
