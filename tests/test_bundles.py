"""Function ends of files that are read as lines, against the row form."""

import random

import pytest
from pyspark.sql import functions as F

from srcgauge.operators import bundles, files, functions
from tests.test_random_code import JS_PIECES

DDL = "file_id string, filename string, code string"


def corpus() -> list[tuple[str, str, str]]:
    rng = random.Random(7)
    rows = []
    for i in range(60):
        glue = rng.choice(["", " ", "\n"])
        pieces = [*JS_PIECES, "}", "}", "{", "\n"]
        rows.append((f"f{i}", f"{i}.js", glue.join(rng.choice(pieces) for _ in range(rng.randint(0, 250)))))
    far = "function a() {\n" + "x {\n}\n" * 80 + "}\n} function b(c) }\n}\n{ {\n" + "\n" * 90 + "}}"
    return [*rows, ("far", "far.js", far), ("flat", "flat.js", "f(a) {"), ("none", "none.js", "x = (y)\n" * 70)]


@pytest.mark.parametrize("chunk_lines", [1, 3, 17, 20_000])
def test_ends_equal_the_row_form(spark, chunk_lines):
    df = spark.createDataFrame(corpus(), DDL)
    spans = functions.function_spans(df)
    want = {(r.file_id, r.startLine, r.endLine) for r in spans.collect()}
    starts = spans.select("file_id", F.col("startLine").alias("line"))
    got = bundles.brace_ends(files.lines(df), starts, chunk_lines).collect()
    assert len(want) > 500 and len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    """A file read in splits has its lines in order, and the ends of the row form."""
    text = "".join(f"function f{i}(a) {{\n if (a) {{\n  b({i})\n }}\n}}\r\n" for i in range(3000))
    (tmp_path / "big.js").write_text(text + "end")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = bundles.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        rows = sorted((r.line, r.text) for r in lines.collect())
        assert [t for _, t in rows] == (text + "end").replace("\r", "").split("\n")
        assert [n for n, _ in rows] == list(range(1, len(rows) + 1))
        starts = lines.filter("text like 'function%'").select("file_id", "line")
        got = bundles.brace_ends(lines, starts, 100).collect()
        assert len(got) == 3000 and all(r.endLine == r.line + 4 for r in got)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_starts_and_no_lines(spark):
    lines = spark.createDataFrame([("a", 1, "{"), ("a", 2, "}")], "file_id string, line int, text string")
    starts = spark.createDataFrame([("a", 2)], "file_id string, line int")
    assert bundles.brace_ends(lines, starts.limit(0)).count() == 0
    assert bundles.brace_ends(lines.limit(0), starts).count() == 0
    assert [tuple(r) for r in bundles.brace_ends(lines, starts).collect()] == [("a", 2, 2)]
