"""Random code, Spark against the SQL twins."""

import random
import time
from pathlib import Path

import pandas as pd
import pytest

from oracles import sql as S
from srcgauge import catalog
from srcgauge.operators import duplicates, files, functions
from srcgauge.plans import analysis
from tests.oracle_check import compare

JS_PIECES = [
    "\n", "\n", "\n", " ", "  ", "{", "}", "}", "(", ")", "if (a) {", "} else if (b) {\n", "else",
    "for (x of y) {\n", "function f(a, b)", "async function g( ) {", "const h = (a, b) =>",
    "let k = async (x) => {", "var m = function (a,) {", "n = (p) => {", "async q = (r)=>", "s(t) {\n",
    "'", '"', "`", "//", "/*", "*/", "* note", "a ?? b", "a?.b", "x ? y : z", "&&", "||", "return",
    "return 1;", "switch (v) {", "case 1:", "while", "catch (e) {", "$x", "9lives", "3.14", "!==",
    "=-", ">>>", "class A", "const t = (1 + 2) * 3", "é", "\t",
]
PY_PIECES = [
    "\n", "\n", "\n", "\n\n", "    ", "        ", "\t", " ", "def f(a):", "def g(self, b: int = 1, *c):\n",
    "async def h( ):", "class K:", "if a:", "elif b:", "else", "for x in y:", "while 1:", "except E:",
    "and", "or", "not", "return", "return x", "match m:", "case 1:", "'", '"', "'''", '"""', "#", "# note",
    "x = a if b else c", "lambda z: z", "`", "3.", "->", ":=", "//", "**", "é", "def broken(",
]


def make_files(seed: int, count: int) -> pd.DataFrame:
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        python = i % 2 == 0
        pieces = PY_PIECES if python else JS_PIECES
        glue = rng.choice(["", " ", " "])
        text = glue.join(rng.choice(pieces) for _ in range(rng.randint(0, 120)))
        name = f"r{i}.py" if python else f"r{i}.js"
        rows.append((i, name, text, "python" if python else "javascript"))
    for path in sorted((Path(__file__).parent / "samples").iterdir()):
        kind = "python" if path.suffix == ".py" else "javascript"
        rows.append((len(rows), path.name, path.read_text(), kind))
    return pd.DataFrame(rows, columns=["file_id", "filename", "code", "language"])


@pytest.fixture(scope="module", params=[1, 2])
def both(request, spark, con):
    frame = make_files(request.param, 400)
    con.execute("DROP TABLE IF EXISTS src")
    con.register("random_files", frame)
    con.execute("CREATE TABLE src AS SELECT * FROM random_files")
    df = spark.createDataFrame(frame.drop(columns="language")).repartition(4)
    return df, con


CASES = {
    "summary": (
        lambda df: catalog.flat_summary(files.file_summary(df)),
        S.W(S.file_metrics(), S.SUMMARY),
    ),
    "functions": (
        lambda df: catalog.flat_functions(functions.functions_all(df)),
        S.W(S.measured_ctes(), S.FUNCTIONS),
    ),
    "lint": (
        lambda df: catalog.flat_issues(analysis.lint_all(df), "issue_ord"),
        S.W(S.issues_ctes(), "SELECT * FROM issues"),
    ),
    "pairs": (
        lambda df: duplicates.duplicate_pairs(df).select(
            "file_id", "i", "j", "first", "second", "percent"
        ),
        S.W(f"{S.function_ctes()},{S.DUP}", "SELECT file_id, i, j, first, second, percent FROM pairs"),
    ),
    "advice": (
        lambda df: analysis.refactor_all(df).select("file_id", "ord", *catalog.SUGGESTION),
        S.W(f"{S.measured_ctes()},{S.advice_cte()}", "SELECT * FROM advice"),
    ),
    "analysis": (
        lambda df: catalog.flat_analysis(analysis.analyze(df)),
        S.analysis_sql(),
    ),
}


@pytest.mark.parametrize("case", list(CASES))
def test_random_code(both, spark, case):
    df, con = both
    ours, twin = CASES[case]
    assert compare(spark, con, lambda *_: ours(df), twin, "") == ""


COPIES = "file_id bigint, filename string, code string"


def near_copies() -> str:
    def body(i: int) -> str:
        extra = " ".join(f"w{j}" for j in range(i % 7))
        return f"function f{i % 3}(a) {{\n one two three four five\n six seven eight\n {extra}\n\n\n}}\n"

    return "".join(body(i) for i in range(60))


def test_listed_and_grouped_pairs_agree(spark):
    df = spark.createDataFrame([(1, "a.js", near_copies())], COPIES)
    listed = duplicates.listed_pairs(df).collect()
    assert len(listed) > 300
    assert sorted(listed) == sorted(duplicates.duplicate_pairs(df).collect())
    groups = duplicates.duplicate_groups(df).collect()
    assert len(groups) < len(listed) / 3 and sum(len(g.a) for g in groups if g.copies) == 60


def test_repeated_ids_and_null_code(spark):
    """Each row is a file of its own; a null code changes no other row."""
    code = near_copies()
    one = spark.createDataFrame([(1, "a.js", code)], COPIES)
    two = spark.createDataFrame([(1, "a.js", code), (1, "a.js", code), (2, "b.js", None)], COPIES)
    for rows in (duplicates.duplicate_pairs, analysis.lint_all):
        assert rows(two).count() == 2 * rows(one).count()
    assert analysis.analyze(two).count() == analysis.analyze(one).count() * 2 + 1


def test_no_job_runs_while_the_plan_is_built(spark):
    df = spark.createDataFrame([(1, "a.js", near_copies())], COPIES)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans")
    try:
        for build in (duplicates.duplicate_pairs, analysis.lint_all, analysis.analyze):
            build(df)
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_many_dissimilar_functions_that_share_a_word(spark):
    """Time follows the functions, not their pairs."""
    def timed(n: int) -> float:
        code = "".join(
            f"function f{i}(a) {{\n sharedword_sharedword a{i} b{i}\n c{i}\n d{i}\n e{i}\n\n}}\n"
            for i in range(n)
        )
        df = spark.createDataFrame([(1, "a.js", code)], COPIES)
        start = time.perf_counter()
        assert duplicates.duplicate_pairs(df).count() == 0
        return time.perf_counter() - start

    timed(500)
    assert timed(5000) < 30
