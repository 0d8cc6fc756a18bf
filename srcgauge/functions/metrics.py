"""Complexity, Halstead, maintainability and nesting as column expressions.

Every expression works on a plain column and inside a lambda alike.
"""

from __future__ import annotations


from string import ascii_letters

from . import sqltext as F
from .sqltext import Expr
from . import fixed
from .arrays import let
from .dialect import CORE, Dialect
from .text import JS, PY, by_language, count_of, ltrim_blanks, strip_family


# -- rounding -----------------------------------------------------------------
def round_to(x: Expr, digits: int, d: Dialect = CORE) -> Expr:
    """Round half up (core) or half to even on the exact value (service)."""
    scale = float(10**digits)
    if d.is_core:
        return F.floor(x * scale + 0.5) / F.lit(scale)

    # The product's rounding error is recovered exactly by splitting x in two
    # halves, so ties are judged on the true value.
    def exact(v: Expr) -> Expr:
        big = v * 134217729.0
        high = big - (big - v)
        return let(
            F.struct(v.alias("v"), high.alias("high"), (v * scale).alias("product")),
            lambda p: nearest(
                p["product"],
                (p["high"] * scale - p["product"]) + (p["v"] - p["high"]) * scale,
            ),
        )

    def nearest(product: Expr, error: Expr) -> Expr:
        whole = F.floor(product).cast("double")
        side = (product - whole - 0.5) + error
        up = (side > 0) | ((side == 0) & (whole % 2 == 1))
        return (whole + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)

    return let(x, exact)


# -- cyclomatic complexity ----------------------------------------------------
def decision_patterns(family: str, d: Dialect = CORE) -> dict[str, str]:
    """One pattern per decision kind; each is counted on its own."""
    if family == PY:
        words = ("if", "elif", "for", "while", "except", "and", "or")
        kinds = {w: d.words(w) for w in words}
        if d.is_core:
            # One conditional expression per line at most. A match is the line from its
            # first `if`, so a line is read once; group 1 tells whether an `else` follows.
            other = d.words("else").replace("else", "(else)")
            kinds["if_else"] = (
                rf"{d.words('if')}[^{d.eol}]*?(?:{other}|(?![^{d.eol}]))[^{d.eol}]*+"
            )
        return kinds
    kinds = {w: d.words(w) for w in ("if", "for", "while", "case", "catch")}
    # The look-behind comes after the first letter, so it is only tried at an `e`.
    kinds["else_if"] = rf"e(?<!{d.w}e)lse{d.s}+if(?!{d.w})"
    kinds["ternary"] = rf"\?{d.s}*[^:]"
    kinds["and"] = "&&"
    kinds["or"] = r"\|\|"
    kinds["nullish"] = r"\?\?"
    return kinds


def decision_counts(clean: Expr, family: str, d: Dialect = CORE) -> Expr:
    return F.struct(
        *(_kind_count(clean, k, p).alias(k) for k, p in decision_patterns(family, d).items())
    )


def _kind_count(clean: Expr, kind: str, pattern: str) -> Expr:
    if kind != "if_else":
        return count_of(clean, pattern)
    lines = F.regexp_extract_all(clean, F.lit(pattern), F.lit(1))
    return F.when(F.contains(clean, "else"), F.size(F.array_remove(lines, ""))).otherwise(0)


def cyclomatic_clean(clean: Expr, family: str, d: Dialect = CORE) -> Expr:
    """1 + all decisions. Kinds that cannot overlap share one pass."""
    kinds = decision_patterns(family, d)
    if family == PY:
        total = 1 + count_of(clean, d.words("if", "elif", "for", "while", "except", "and", "or"))
        return total + _kind_count(clean, "if_else", kinds["if_else"]) if d.is_core else total
    plain = d.words("if", "for", "while", "case", "catch")
    passes = [rf"(?=[cfiw&|?])(?:{plain}|&&|\|\||\?\?)", kinds["else_if"], kinds["ternary"]]
    total = F.lit(1)
    for pattern, hint in zip(passes, (None, "else", "?")):
        total = total + count_of(clean, pattern, hint)
    return total


def cyclomatic(code: Expr, lang: Expr, d: Dialect = CORE) -> Expr:
    python = let(strip_family(code, PY, d), lambda x: cyclomatic_clean(x, PY, d))
    braces = let(strip_family(code, JS, d), lambda x: cyclomatic_clean(x, JS, d))
    chosen = by_language(lang, python, braces)
    return F.when(lang == "unknown", 1).otherwise(chosen) if d.is_core else chosen


# -- Halstead -----------------------------------------------------------------
def token_pattern(d: Dialect = CORE) -> str:
    # Numbers come first, so a name may begin with any word character here.
    # Letters are spelled out: Java tests such a class with one table look-up,
    # ranges one by one.
    head = f"[{ascii_letters}0123456789_$]"
    parts = [
        rf"[{d.digit}]++\.?[{d.digit}]*+",
        rf"{head}{d.w}*+",
        r"[+\-*/%=!<>&|^~?:]++",
    ]
    if d.is_core:  # quoted text is swallowed and never counted
        parts += ['"[^"]*+"', "'[^']*+'", "`[^`]*+`"]
    return "|".join(parts)


def token_extract(clean: Expr, d: Dialect = CORE) -> Expr:
    return F.regexp_extract_all(clean, F.lit(token_pattern(d)), F.lit(0))


def operator_words(family: str) -> list[str]:
    if family == PY:
        return sorted(set(fixed.PY_SYMBOLS) | set(fixed.PY_KEYWORDS))
    return sorted(set(fixed.JS_SYMBOLS) | set(fixed.JS_KEYWORDS))


def is_operator(token: Expr, family: str) -> Expr:
    return token.isin(*operator_words(family))


def has_symbol_head(token: Expr) -> Expr:
    return F.substring(token, 1, 1).isin(*fixed.NON_OPERAND_HEADS)


def is_operand(token: Expr, family: str) -> Expr:
    return ~is_operator(token, family) & ~has_symbol_head(token)


def token_class(token: Expr, lang: Expr) -> Expr:
    def of(family: str) -> Expr:
        return (
            F.when(is_operator(token, family), "operator")
            .when(is_operand(token, family), "operand")
            .otherwise("ignored")
        )

    return by_language(lang, of(PY), of(JS))


def halstead_of(counts: Expr, d: Dialect = CORE) -> Expr:
    """The metrics of struct(n1, n2, t1, t2), distinct and total operators and operands."""

    def numbers(c: Expr) -> Expr:
        n1, n2, t1, t2 = (c[k] for k in ("n1", "n2", "t1", "t2"))
        vocabulary, length = n1 + n2, t1 + t2
        volume = F.when(length > 0, length * F.log2(vocabulary.cast("double"))).otherwise(
            F.lit(0.0)
        )
        difficulty = F.when(n2 > 0, (n1 / F.lit(2.0)) * (t2 / n2)).otherwise(F.lit(0.0))
        return let(
            F.struct(volume.alias("v"), difficulty.alias("d")),
            lambda x: F.struct(
                n1.alias("uniqueOperators"),
                n2.alias("uniqueOperands"),
                t1.alias("totalOperators"),
                t2.alias("totalOperands"),
                vocabulary.alias("vocabulary"),
                length.alias("length"),
                round_to(x["v"], 2, d).alias("volume"),
                round_to(x["d"], 2, d).alias("difficulty"),
                round_to(x["v"] * x["d"], 2, d).alias("effort"),
                round_to(x["v"] * x["d"] / 18.0, 2, d).alias("time"),
                round_to(x["v"] / 3000.0, 3, d).alias("bugs"),
            ),
        )

    return let(counts, numbers)


def operators_and_operands(tokens: Expr, family: str) -> Expr:
    """struct(ops, opnds) of a text's tokens."""
    return let(
        tokens,
        lambda ts: F.struct(
            F.filter(ts, lambda t: is_operator(t, family)).alias("ops"),
            F.filter(
                F.filter(ts, lambda t: ~is_operator(t, family)), lambda t: ~has_symbol_head(t)
            ).alias("opnds"),
        ),
    )


def halstead_clean(clean: Expr, family: str, d: Dialect = CORE) -> Expr:
    counts = let(
        operators_and_operands(token_extract(clean, d), family),
        lambda t: F.struct(
            F.size(F.array_distinct(t["ops"])).alias("n1"),
            F.size(F.array_distinct(t["opnds"])).alias("n2"),
            F.size(t["ops"]).alias("t1"),
            F.size(t["opnds"]).alias("t2"),
        ),
    )
    return halstead_of(counts, d)


def halstead(code: Expr, lang: Expr, d: Dialect = CORE) -> Expr:
    return by_language(
        lang,
        halstead_clean(strip_family(code, PY, d), PY, d),
        halstead_clean(strip_family(code, JS, d), JS, d),
    )


def token_totals(clean: Expr, lang: Expr, d: Dialect = CORE) -> Expr:
    """Struct n1, n2 (distinct) and N1, N2 (total) as total_*/unique_* fields."""

    def of(family: str) -> Expr:
        h = halstead_clean(clean, family, d)
        return F.struct(
            *(
                h[k].alias(k)
                for k in ("uniqueOperators", "uniqueOperands", "totalOperators", "totalOperands")
            )
        )

    return by_language(lang, of(PY), of(JS))


# -- maintainability and bands ------------------------------------------------
def maintainability(volume: Expr, cc: Expr, loc: Expr, d: Dialect = CORE) -> Expr:
    raw = (
        F.lit(171.0)
        - 5.2 * F.ln(F.greatest(volume, F.lit(1e-300)))
        - 0.23 * cc
        - 16.2 * F.ln(F.greatest(loc.cast("double"), F.lit(1.0)))
    )
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100.0 / 171.0))
    return F.when((loc <= 0) | (volume <= 0), F.lit(100.0)).otherwise(round_to(scaled, 2, d))


def _level(label: str, color: str, level: int) -> Expr:
    return F.struct(
        F.lit(label).alias("label"), F.lit(color).alias("color"), F.lit(level).alias("level")
    )


def cc_level(cc: Expr) -> Expr:
    worst = _level(*fixed.CC_WORST)
    for limit, *band in reversed(fixed.CC_BANDS):
        worst = F.when(cc <= limit, _level(*band)).otherwise(worst)
    return worst


def mi_level(mi: Expr) -> Expr:
    worst = _level(*fixed.MI_WORST)
    for limit, *band in reversed(fixed.MI_BANDS):
        worst = F.when(mi >= limit, _level(*band)).otherwise(worst)
    return worst


# -- nesting and returns ------------------------------------------------------
def nesting_brace(body: Expr) -> Expr:
    """Highest running brace depth, never below zero."""
    return F.aggregate(
        F.regexp_extract_all(body, F.lit("[{}]"), F.lit(0)),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("top")),
        lambda s, b: let(
            s["depth"] + F.when(b == "{", 1).otherwise(-1),
            lambda n: F.struct(n.alias("depth"), F.greatest(s["top"], n).alias("top")),
        ),
        lambda s: s["top"],
    )


def _brace_part(text: Expr) -> Expr:
    """struct(base, top) of some lines: how deep they end and their highest depth, which
    is null without a brace."""
    return F.aggregate(
        F.regexp_extract_all(text, F.lit("[{}]"), F.lit(0)),
        F.struct(F.lit(0).alias("base"), F.lit(None).cast("int").alias("top")),
        lambda s, b: let(
            s["base"] + F.when(b == "{", 1).otherwise(-1),
            lambda n: F.struct(n.alias("base"), F.greatest(s["top"], n).alias("top")),
        ),
    )


def nesting_indent(body: Expr, d: Dialect = CORE) -> Expr:
    """Deepest indent over the first non-blank line's, in steps of four."""
    return let(_indent_part(body, d), lambda x: _indent_steps(x["top"], x["base"]))


def _indent_steps(top: Expr, base: Expr) -> Expr:
    return F.coalesce(F.floor((top - base) / F.lit(4.0)).cast("int"), F.lit(0))


def _indent_part(text: Expr, d: Dialect) -> Expr:
    """struct(base, top) of some lines: the first indent and the deepest; null without a
    non-blank line."""
    indents = F.transform(
        F.regexp_extract_all(
            text, F.lit(rf"(?<![^\n])([{d.inline_space}]*+)(?=[^{d.space}])"), F.lit(1)
        ),
        lambda lead: F.length(lead),
    )
    return let(
        indents,
        lambda xs: F.struct(
            F.get(xs, F.lit(0)).alias("base"), F.array_max(xs).alias("top")
        ),
    )


def nesting(body: Expr, family: str, d: Dialect = CORE) -> Expr:
    return nesting_indent(body, d) if family == PY else nesting_brace(body)


def nesting_part(text: Expr, family: str, d: Dialect = CORE) -> Expr:
    """What some lines add to the nesting of a body that holds them."""
    return _indent_part(text, d) if family == PY else _brace_part(text)


def nesting_of(parts: Expr, family: str) -> Expr:
    """The nesting of the lines that the parts are of, one after the other."""
    if family == PY:
        bases = F.filter(F.transform(parts, lambda x: x["base"]), lambda n: n.is_not_null())
        top = F.array_max(F.transform(parts, lambda x: x["top"]))
        return _indent_steps(top, F.get(bases, F.lit(0)))
    return F.aggregate(
        parts,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("top")),
        lambda s, x: F.struct(
            (s["depth"] + x["base"]).alias("depth"),
            F.greatest(s["top"], s["depth"] + x["top"]).alias("top"),
        ),
        lambda s: s["top"],
    )


def return_count(body: Expr, d: Dialect = CORE) -> Expr:
    return count_of(body, d.words("return"), "return")


# -- heat ---------------------------------------------------------------------
def heat_alpha(intensity: Expr) -> Expr:
    return F.lit(0.08) + intensity * 0.18


def rgb_part(color: Expr, part: int) -> Expr:
    return F.conv(F.substring(color, 2 + 2 * part, 2), 16, 10).cast("int")


def distinct_words(body: Expr, d: Dialect = CORE) -> Expr:
    """The set of blank-separated words of a raw body; an empty body has ''.

    A body of ASCII whose only white space are blanks and newlines is cut at these alone.
    """
    others = [c for c in d.space_chars if c not in " \n" and c < "\x80"]
    plain = F.octet_length(body) == F.length(body)
    for c in others:
        plain = plain & ~F.contains(body, c)
    # Indents go before the cut, which would make an empty word of each blank.
    blanks = F.array_join(F.transform(F.split(body, "\n", -1), lambda line: ltrim_blanks(line)), " ")
    cut = let(
        F.array_remove(F.array_distinct(F.split(blanks, " ", -1)), ""),
        lambda words: F.when(F.size(words) > 0, words).otherwise(F.array("")),
    )
    return F.when(plain, cut).otherwise(F.array_distinct(F.split(trim_runs(body, d), " ", -1)))


def trim_runs(body: Expr, d: Dialect = CORE) -> Expr:
    return F.trim(F.regexp_replace(body, rf"{d.s}++", " "))


def token_jaccard(a: Expr, b: Expr) -> Expr:
    """Jaccard similarity of two word sets."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


