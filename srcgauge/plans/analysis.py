"""The whole analysis: one nested row per file.

Everything about a file is computed inside its row, so the plan is a single
projection over the scan, for files of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import findings, fntable, similar
from ..functions import sqltext as E
from ..functions.arrays import empty, let
from ..functions.dialect import CORE, Dialect, dialect
from ..functions.sqltext import Expr
from ..operators import duplicates
from ..operators.files import CODE, LANG, summary_struct, supported
from ..operators.functions import explode_rows, posexplode_rows, with_functions

FNS = E.col("fns")
FOUND = E.col("found")
KEYS = ("file_id", "filename", "language")
#: Duplicate pairs of one analysis document, about; a file with more has several.
DOCUMENT_PAIRS = 65_536


MEASURES = ("cc", "nesting", "returns")


def function_tables(
    files: DataFrame,
    profile: str | Dialect = CORE,
    want: tuple[str, ...] = MEASURES,
    anchor: str = "reference",
) -> DataFrame:
    """What findings are made of, one row per file: its keys, ``code``, its function table
    ``fns`` with the measures, and ``cases``, the counted switch cases.

    Without ``code`` this can be stored; ``issues_of`` and ``suggestions_of`` take the stored
    table, so other limits need no new search for functions, and no join.
    """
    d = dialect(profile)
    if d.is_core:
        want = (*want, "words")
    cases = findings.case_count(CODE, LANG, d) if d.is_core else E.lit(0)
    found = with_functions(files, d, want, anchor)
    own = [fntable.WHOLE] if fntable.WHOLE in want else []
    return found.select(*KEYS, "code", "fns", *own, cases.alias("cases").column)


def issues_of(
    tables: DataFrame,
    profile: str | Dialect = CORE,
    thresholds: Mapping[str, object] | None = None,
) -> DataFrame:
    """Function tables with the ordered array ``issues`` of all findings but duplicates, which
    come last, and what is ``found`` of these. ``issue_rows`` makes the findings of it."""
    d = dialect(profile)
    issues = findings.function_issues(FNS, findings.resolve_limits(thresholds), d)
    if not d.is_core:  # the service has neither a switch nor a duplicate rule
        nothing = E.lit(None).cast(similar.FOUND_DDL).alias("found")
        return tables.withColumn("issues", issues.column).withColumn("found", nothing.column)
    issues = E.concat(issues, findings.switch_issues(E.col("cases")))
    return duplicates.with_duplicates(tables.withColumn("issues", issues.column))


def suggestions_of(tables: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Function tables with ``refactorSuggestions``; ``suggestion_rows`` spreads them."""
    made = findings.suggestions(FNS, LANG, dialect(profile))
    return tables.withColumn("refactorSuggestions", made.column)


def with_issues(
    files: DataFrame,
    profile: str | Dialect = CORE,
    thresholds: Mapping[str, object] | None = None,
    want: tuple[str, ...] = MEASURES,
    anchor: str = "reference",
) -> DataFrame:
    """``issues_of`` the function tables of files."""
    return issues_of(function_tables(files, profile, want, anchor), profile, thresholds)


def with_findings(
    files: DataFrame,
    profile: str | Dialect = CORE,
    thresholds: Mapping[str, object] | None = None,
) -> DataFrame:
    """``with_issues`` and ``refactorSuggestions``, from one search for functions;
    ``issue_rows`` and ``suggestion_rows`` take it."""
    return suggestions_of(with_issues(files, profile, thresholds), profile)


def issue_count() -> Expr:
    """The number of findings of a file, duplicates counted without their pairs."""
    return (E.size(E.col("issues")) + similar.pair_count(FOUND)).cast("int")


def spread(found: DataFrame, item: Callable[[Expr, Expr], Expr], more: Expr | None = None) -> DataFrame:
    """Rows (file_id, x): ``item(issue, issue_ord)`` of every finding, and the items of ``more``.

    A file's first rows come from the findings in its row. Its duplicate pairs are made
    afterwards, in blocks whose size is bounded by the file's functions; the place of a
    pair is known from the counts, so blocks need no order among them.
    """
    issues = E.col("issues")
    items = E.transform(issues, lambda x, i: item(x, i))
    if more is not None:
        items = E.concat(items, more)
    blocks = E.transform(
        similar.head_blocks(FOUND, duplicates.BLOCK_PAIRS),
        lambda b: E.struct(
            (b["start"] + E.size(issues)).cast("int").alias("start"), b["heads"].alias("heads")
        ),
    )
    first = E.struct(
        E.lit(0).alias("start"), empty(similar.HEAD_DDL).alias("heads"), items.alias("items")
    )
    later = let(
        E.slice(items, 1, 0),
        lambda none: E.transform(
            E.coalesce(blocks, E.slice(blocks, 1, 0)),
            lambda b: E.struct(b["start"].alias("start"), b["heads"].alias("heads"), none.alias("items")),
        ),
    )
    parts = explode_rows(
        found, E.concat(E.array(first), E.coalesce(later, E.slice(E.array(first), 1, 0))), "part",
        "file_id", F.col("found.cells").alias("cells"),
    )
    part = E.col("part")
    pairs = E.transform(
        similar.block_pairs(E.col("cells"), part["heads"]),
        lambda p, i: item(findings.duplicate_issue(p), part["start"] + i),
    )
    made = E.when(E.size(part["heads"]) > 0, pairs).otherwise(part["items"])
    return explode_rows(parts, made, "x", "file_id")


def issue_rows(found: DataFrame) -> DataFrame:
    """One row per finding of analysed files, with its place ``issue_ord`` in the file."""
    placed = spread(found, lambda x, i: E.struct(i.alias("issue_ord"), x.alias("issue")))
    return placed.select("file_id", "x.issue_ord", "x.issue.*")


def suggestion_rows(found: DataFrame) -> DataFrame:
    """One row per suggestion of analysed files, with its place ``ord`` in the file."""
    return posexplode_rows(
        found, E.col("refactorSuggestions"), "ord", "x", "file_id"
    ).select("file_id", "ord", "x.*")


def lint_all(
    files: DataFrame,
    profile: str | Dialect = CORE,
    thresholds: Mapping[str, object] | None = None,
) -> DataFrame:
    """One row per finding with its place ``issue_ord`` in the file."""
    return issue_rows(with_issues(files, profile, thresholds))


def lint_rule(
    files: DataFrame,
    rule: str,
    profile: str | Dialect = CORE,
    thresholds: Mapping[str, object] | None = None,
) -> DataFrame:
    """Findings of one per-function rule; only what the rule reads is measured."""
    d = dialect(profile)
    check, want = {
        "length": (findings.lint_function_length, ()),
        "nesting": (findings.lint_nesting, ("nesting",)),
        "params": (findings.lint_params, ()),
        "returns": (findings.lint_returns, ("returns",)),
        "complexity": (findings.lint_complexity, ("cc",)),
    }[rule]
    limits = findings.resolve_limits(thresholds)
    return _per_function(files, d, want, lambda f: check(f, limits, d))


def _per_function(files: DataFrame, d: Dialect, want: tuple[str, ...], check) -> DataFrame:
    found = E.filter(
        E.transform(FNS, lambda f: E.struct(f["ord"].alias("ord"), check(f).alias("x"))),
        lambda r: r["x"].is_not_null(),
    )
    return explode_rows(with_functions(files, d, want), found, "r", "file_id").select(
        "file_id", "r.ord", "r.x.*"
    )


def lint_large_switch(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    d = dialect(profile)
    cases = findings.case_count(CODE, LANG, d)
    counted = supported(files).select("file_id", cases.alias("cases").column)
    return explode_rows(
        counted, findings.switch_issues(E.col("cases")), "x", "file_id"
    ).select("file_id", "x.*")


def lint_duplicate(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    pairs = duplicates.duplicate_pairs(files, profile)
    issue = findings.duplicate_issue(E.struct(*(E.col(k).alias(k) for k in duplicates.COLUMNS)))
    return pairs.select("file_id", "i", "j", issue.alias("x").column).select(
        "file_id", "i", "j", "x.*"
    )


def refactor_rule(
    files: DataFrame, rule: str, profile: str | Dialect = CORE
) -> DataFrame:
    """Suggestions of one rule, before deduplication."""
    d = dialect(profile)
    check, want = {
        "decompose": (findings.refactor_decompose, ("cc",)),
        "param_object": (findings.refactor_param_object, ()),
        "extract": (findings.refactor_extract, ()),
        "flatten": (findings.refactor_flatten, ("nesting",)),
    }[rule]
    return _per_function(files, d, want, lambda f: check(f, LANG, d))


def refactor_all(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """All suggestions in order, with their place ``ord`` in the file."""
    d = dialect(profile)
    return posexplode_rows(
        with_functions(files, d, ("cc", "nesting")),
        findings.suggestions(FNS, LANG, d), "ord", "x", "file_id", "language",
    ).select("file_id", "ord", "x.*")


def analyze(
    files: DataFrame,
    profile: str | Dialect = CORE,
    thresholds: Mapping[str, object] | None = None,
    anchor: str = "reference",
) -> DataFrame:
    """The nested analysis document of every supported file.

    ``issueCount`` counts all its findings. A file with more than some ``DOCUMENT_PAIRS``
    duplicate pairs, which no row could hold, has further documents (``part`` 1, 2, ...),
    which carry on its ``linterIssues`` and whose other arrays are empty.
    """
    d = dialect(profile)
    want = ("cc", "halstead", "nesting", "returns", fntable.WHOLE)
    found = with_issues(files, d, thresholds, want, anchor)
    if d.is_core:
        blocks = similar.head_blocks(FOUND, DOCUMENT_PAIRS)
        found = found.withColumn("blocks", blocks.column).withColumn(
            "part", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("blocks") - 1, F.lit(0))))
        )
        pairs = E.transform(
            similar.block_pairs(
                E.col("found.cells"),
                E.coalesce(E.get(E.col("blocks"), E.col("part"))["heads"], empty(similar.HEAD_DDL)),
            ),
            findings.duplicate_issue,
        )
    else:
        found, pairs = found.withColumn("part", F.lit(0)), empty(findings.ISSUE_DDL)
    whole = E.col("part") == 0
    only_once = lambda items: E.when(whole, items).otherwise(E.slice(items, 1, 0))
    return found.select(
        *KEYS,
        summary_struct(CODE, LANG, E.size(FNS), d, E.col("whole")).alias("summary").column,
        only_once(E.transform(FNS, fntable.public_function)).alias("functions").column,
        E.concat(only_once(E.col("issues")), pairs).alias("linterIssues").column,
        only_once(findings.suggestions(FNS, LANG, d)).alias("refactorSuggestions").column,
        only_once(E.transform(FNS, fntable.heat_region)).alias("heatmap").column,
        issue_count().alias("issueCount").column,
        "part",
    )


def result_json(analysis: DataFrame) -> DataFrame:
    """One JSON text per document."""
    fields = [
        "language", "filename", "summary", "functions", "linterIssues", "refactorSuggestions",
        "heatmap",
    ]
    return analysis.select("file_id", F.to_json(F.struct(*fields)).alias("result"))


def file_counts(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Functions, issues and suggestions per file."""
    d = dialect(profile)
    return with_issues(files, d).select(
        "file_id",
        F.size("fns").alias("functionCount"),
        issue_count().alias("issueCount").column,
        E.size(findings.suggestions(FNS, LANG, d)).alias("suggestionCount").column,
    )
