"""Steps of the function search and of the word sets that need no pattern."""

import random

import pytest

from srcgauge.functions import metrics, similar, spans, text
from srcgauge.functions import sqltext as E
from srcgauge.functions.dialect import CORE, SERVICE
from srcgauge.operators import duplicates

CODE = E.col("code")


def values(spark, expression, codes):
    df = spark.createDataFrame(list(enumerate(codes)), "i int, code string").repartition(1)
    rows = df.select("i", expression.alias("x").column).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_unclosed_parentheses_are_looked_for_once():
    assert spans.js_matches(CODE).text.count(f"{{{spans.UNCLOSED_RUN}}}") == 1
    assert "regexp_extract_all" not in spans._found(CODE, "a+").text


def test_unclosed_runs(spark):
    n = spans.UNCLOSED_RUN
    codes = ["", "(" * (n - 1), "(" * n, "(" * n + ")", "(a" * n, "(" * (n - 1) + ")" + "(" * (n - 1), "()" * n]
    got = values(spark, spans.has_unclosed_run(CODE), codes)
    assert got == [False, False, True, True, True, False, False]


def test_matches_have_their_lines(spark):
    codes = ["", "a", "x", "\n\naxa\nxx\na\n\naa", "é\naé\n a", "aa\n" * 300, "a\r\na"]
    got = values(spark, spans._found(CODE, "a+\n?"), codes)

    def want(code):
        import re

        return [(code.count("\n", 0, m.start()) + 1, m[0]) for m in re.finditer("a+\n?", code)]

    assert [[tuple(m) for m in ms] for ms in got] == [want(code) for code in codes]


@pytest.mark.parametrize("d", [CORE, SERVICE], ids=lambda d: d.name)
def test_word_sets(spark, d):
    draw = random.Random(3)
    pieces = ["a", "b1", " ", "  ", "    ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "é", "　", "(", "x" * 9]
    plain = ["a", "b1", " ", "  ", "      ", "\n", "\n\n", "\x1b", "(", "x" * 9]
    codes = ["", " ", "\n \n", "a", " a", "a\n"]
    codes += ["".join(draw.choices(p, k=draw.randint(0, 12))) for p in (pieces, plain) for _ in range(150)]
    got = values(spark, metrics.distinct_words(CODE, d), codes)
    spaced = values(spark, metrics.trim_runs(CODE, d), codes)
    assert [len(words) for words in got] == [len(set(words)) for words in got]
    assert [set(words) for words in got] == [set(text.split(" ")) for text in spaced]


@pytest.mark.parametrize("d", [CORE, SERVICE], ids=lambda d: d.name)
def test_lines_are_trimmed_once(spark, d):
    codes = ["", " ", "a", "  a ", "\ta", " \t a", "\xa0a", "  é", "   x", "\x1c a", "\t", "　"]
    assert values(spark, text.ltrim_once(CODE, d), codes) == values(spark, text.ltrim_space(CODE, d), codes)


def test_few_functions_without_a_pair_are_told_by_their_words(spark):
    body = "a b c d e f g h i j".split()
    near, other = [*body, "k"], [*body[:8], "x", "y", "z"]
    sets = [[], [body], [body, body], [body, other], [other, body, near], [other, body[:8]], [[""], [""]]]
    rows = [(k, [(words, 9) for words in found]) for k, found in enumerate(sets)]
    df = spark.createDataFrame(rows, "i int, fns array<struct<words:array<string>,loc:int>>")
    got = df.orderBy("i").filter("size(fns) > 1").select(similar.any_pair(E.col("fns")).column)
    assert [r[0] for r in got.collect()] == [True, False, True, False, True]


@pytest.mark.parametrize("extra", [0, 1, 8])
def test_pairs_of_few_and_of_many_functions(spark, extra):
    """The same pairs whether the quick comparison is made or not."""
    lines = "\n".join(f"    w{i} = {i}" for i in range(12))
    alone = lambda k: f"def g{k}():\n" + "\n".join(f"    u{k}_{i} = {i}" for i in range(9))
    code = "\n".join([f"def f1():\n{lines}", *map(alone, range(extra)), f"def f2():\n{lines}"])
    files = spark.createDataFrame([(1, "a.py", code)], "file_id int, filename string, code string")
    pairs = duplicates.duplicate_pairs(files).collect()
    assert [(p["first"], p["second"]) for p in pairs] == [("f1", "f2")]
    lone = spark.createDataFrame(
        [(1, "a.py", "\n".join(map(alone, range(extra + 2))))], "file_id int, filename string, code string"
    )
    assert duplicates.duplicate_pairs(lone).collect() == []
