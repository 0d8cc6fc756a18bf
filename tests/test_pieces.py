"""Bodies measured from the pieces between functions, against bodies read as a whole."""

import time

import pytest

from srcgauge.functions import sqltext as E
from srcgauge.functions import text
from srcgauge.functions.dialect import CORE, SERVICE
from srcgauge.functions.text import JS, PY
from srcgauge.operators import files as per_file
from srcgauge.operators import functions
from srcgauge.plans import analysis
from tests.test_random_code import make_files

MEASURES = ("cc", "halstead", "nesting", "returns", "words")
DDL = "file_id bigint, filename string, code string"
EDGES = [
    "function a() {\n  x = 1\n  } else\n  if (b) {\n  y = c ?\n  (d) {\n  : e\n }\n}\n}",
    "function a() {\n let u = \"http://x\";\n f(b) {\n return 'y'\n }\n}\nfunction c() { return \"z\" }",
    "function a() {\n /* one\n g(h) {\n two */ return 1\n }\n}",
    "function a() {\n `one\n g(h) {\n two` return 1\n }\n}",
    "def a():\n    '''one\n    def b(c):\n        two'''\n    return 1\n  \ndef c():\n    pass",
    "def a():\n    x = `if\n    def b(c):\n        y`\n    return 'if' if x else 1\n",
    "\n\n  def a(): return 1\n def b(): return 2\n\n\n",
    "", "\n", "{", "}",
]


@pytest.mark.parametrize("d", [CORE, SERVICE], ids=lambda d: d.name)
def test_bodies_are_told_from_their_pieces(spark, d):
    frame = make_files(5, 300).drop(columns="language")
    rows = list(frame.itertuples(index=False, name=None))
    rows += [(1000 + 2 * i + k, f"e{i}.{end}", code) for i, code in enumerate(EDGES) for k, end in enumerate(("js", "py"))]
    df = spark.createDataFrame(rows, DDL).repartition(4).cache()
    by_pieces = functions.with_functions(df, d, MEASURES)
    as_whole = functions.with_functions(df, d, (*MEASURES, "body"))
    plain = E.transform(
        E.col("fns"), lambda f: E.struct(*(f[k].alias(k) for k in by_pieces.schema["fns"].dataType.elementType.names))
    )
    got = {r.file_id: r.fns for r in by_pieces.select("file_id", "fns").collect()}
    want = {r.file_id: r.fns for r in as_whole.select("file_id", plain.alias("fns").column).collect()}
    assert got == want and sum(map(len, got.values())) > 300


def test_a_file_is_told_from_its_pieces(spark):
    df = spark.createDataFrame(
        list(make_files(6, 200).drop(columns="language").itertuples(index=False, name=None)), DDL
    )
    summary = "summary.cyclomaticComplexity", "summary.halstead"
    got = {r[0]: r[1:] for r in analysis.analyze(df).select("file_id", *summary).collect()}
    own = per_file.file_summary(df).select("file_id", "cyclomaticComplexity", "halstead")
    assert got == {r[0]: r[1:] for r in own.collect()}


def test_open_pieces(spark):
    texts = {"a 'b": False, "a 'b' \"c\"": True, "/* a": False, "/* a */ 'b'": True, "// don't": True, "`": False}
    df = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], DDL)
    for family, changed in ((JS, {}), (PY, {"/* a": True, "// don't": False, "`": True})):
        closed = text.strip_closed(E.col("code"), family)["closed"]
        got = df.orderBy("file_id").select(closed.alias("x").column).collect()
        assert [r[0] for r in got] == list((texts | changed).values())


def test_time_does_not_follow_the_depth_of_functions(spark):
    """A line is measured once, however many functions hold it."""
    inner = "".join(f"total{i % 50} += value{i % 70} * {i % 100}; // step\n" for i in range(16_000))

    def timed(depth: int) -> float:
        code = "".join(f"outer{i}(a) {{\n" for i in range(depth)) + inner + "}\n" * depth
        df = spark.createDataFrame([(1, "a.js", code)], DDL).repartition(1).cache()
        assert df.count() == 1
        start = time.perf_counter()
        found = functions.with_functions(df, "core", MEASURES).select("fns").first().fns
        taken = time.perf_counter() - start
        assert len(found) == depth
        assert {f.halstead.totalOperands for f in found[:1]} == {48_000 + 2 * depth}
        return taken

    timed(1)
    assert timed(150) < 6
