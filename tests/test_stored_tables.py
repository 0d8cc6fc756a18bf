"""Findings from a stored function table."""

import pytest

from srcgauge.plans import analysis
from srcgauge.sources import corpora


@pytest.fixture(scope="module", params=["core", "service"])
def stored(request, spark, sf_dir, tmp_path_factory):
    files = corpora.code_files(spark, sf_dir)
    path = str(tmp_path_factory.mktemp("tables") / request.param)
    analysis.function_tables(files, request.param).drop("code").write.parquet(path)
    return files, request.param, spark.read.parquet(path)


LIMITS = [None, {"loc": 30, "nesting": "2", "params": 4, "cc": "8 branches"}]


@pytest.mark.parametrize("limits", LIMITS)
def test_findings_equal_those_of_the_files(stored, limits):
    files, profile, tables = stored
    got = analysis.issue_rows(analysis.issues_of(tables, profile, limits))
    want = analysis.lint_all(files, profile, limits)
    assert got.columns == want.columns
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, want.collect())) and len(rows) > 50


def test_suggestions_equal_those_of_the_files(stored):
    files, profile, tables = stored
    got = analysis.suggestion_rows(analysis.suggestions_of(tables, profile))
    want = analysis.refactor_all(files, profile)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_shuffle_and_no_search(stored):
    _, profile, tables = stored
    for rows in (
        analysis.issue_rows(analysis.issues_of(tables, profile)),
        analysis.suggestion_rows(analysis.suggestions_of(tables, profile)),
    ):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "regexp" not in plan.replace("regexp_extract", "")
