"""Function tables: one row per function found in a file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import findings, fntable, metrics, spans
from ..functions import sqltext as E
from ..functions.dialect import CORE, Dialect, dialect
from ..functions.text import JS, PY, strip_family
from ..functions.sqltext import Expr
from .files import CODE, LANG, supported


def with_functions(
    files: DataFrame,
    profile: str | Dialect = CORE,
    want: Iterable[str] = (),
    anchor: str = "reference",
) -> DataFrame:
    """Supported files with their function table in the array column ``fns``; with
    ``whole`` among the wanted, the file's own metrics in the column of that name."""
    d = dialect(profile)
    known = supported(files)
    kept = [*known.columns, "fns", *([fntable.WHOLE] if fntable.WHOLE in want else [])]
    for name, step in fntable.steps(CODE, LANG, d, want, anchor).items():
        known = known.withColumn(name, step.column)
    return known.select(*kept)


def explode_rows(df: DataFrame, items: Expr, name: str, *keys: str) -> DataFrame:
    """One row per item of an array.

    An outer explode with the null dropped afterwards: the inner one makes the
    optimizer test the array's size below it, which evaluates the array twice.
    """
    return df.select(*keys, F.explode_outer(items.column).alias(name)).filter(
        F.col(name).isNotNull()
    )


def posexplode_rows(df: DataFrame, items: Expr, pos: str, name: str, *keys: str) -> DataFrame:
    """As ``explode_rows``, with the position in the array."""
    return df.select(*keys, F.posexplode_outer(items.column).alias(pos, name)).filter(
        F.col(name).isNotNull()
    )


def exploded(
    files: DataFrame,
    profile: str | Dialect = CORE,
    want: Iterable[str] = (),
    anchor: str = "reference",
) -> DataFrame:
    """One row per function: file_id, filename, language, f (struct)."""
    return explode_rows(
        with_functions(files, profile, want, anchor), E.col("fns"), "f",
        "file_id", "filename", "language",
    )


def functions_js_raw(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Every match of every JavaScript pattern, before deduplication."""
    d = dialect(profile)
    braces = supported(files).filter((LANG != "python").column)
    return explode_rows(braces, spans.js_matches(CODE, d), "m", "file_id").select(
        "file_id",
        "m.pattern",
        "m.seq",
        "m.name",
        spans.params_js(E.col("m.params"), d).alias("params").column,
        F.col("m.start").alias("startLine"),
    )


def functions_dedupe(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """First match per file, name and start line.

    All matches of a file come from one row, so they are deduplicated there.
    """
    d = dialect(profile)
    braces = supported(files).filter((LANG != "python").column)
    return explode_rows(braces, spans.js_deduped(CODE, d), "m", "file_id").select(
        "file_id", "m.name", F.col("m.start").alias("startLine"), "m.pattern", "m.seq"
    )


def functions_py_raw(
    files: DataFrame, profile: str | Dialect = CORE, anchor: str = "reference"
) -> DataFrame:
    d = dialect(profile)
    indented = supported(files).filter((LANG == "python").column)
    return explode_rows(indented, spans.py_matches(CODE, d, anchor), "m", "file_id").select(
        "file_id",
        "m.seq",
        "m.name",
        spans.params_py(E.col("m.params"), d).alias("params").column,
        F.col("m.start").alias("startLine"),
        F.col("m.base").alias("indent"),
    )


def function_spans(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Name, start and end line of every function."""
    return exploded(files, profile).select(
        "file_id", "language", "f.ord", "f.name", "f.startLine", "f.endLine", "f.loc"
    )


def function_bodies(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    return exploded(files, profile, ("body",)).select("file_id", "f.ord", "f.name", "f.body")


def functions_all(
    files: DataFrame, profile: str | Dialect = CORE, anchor: str = "reference"
) -> DataFrame:
    """The full function table with metrics and heat; no shuffle."""
    return exploded(files, profile, ("cc", "halstead", "nesting"), anchor).select(
        "file_id", "filename", "language", "f.ord", *(f"f.{k}" for k in fntable.PUBLIC_FIELDS)
    )


def functions_ranked(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Functions of each file by falling complexity, ties in file order."""
    ranked = E.sort_array(
        E.transform(
            E.col("fns"),
            lambda f: E.struct(
                (-f["cyclomaticComplexity"]).alias("key"),
                f["ord"].alias("ord"),
                f["name"].alias("name"),
                f["startLine"].alias("startLine"),
            ),
        )
    )
    return posexplode_rows(
        with_functions(files, profile, ("cc",)), ranked, "pos", "r", "file_id"
    ).select(
        "file_id",
        (F.col("pos") + 1).alias("rank"),
        "r.ord",
        "r.name",
        "r.startLine",
        (-F.col("r.key")).alias("cyclomaticComplexity"),
    )


def nesting_and_returns(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    return exploded(files, profile, ("nesting", "returns")).select(
        "file_id", "language", "f.ord", "f.name", "f.maxNestingDepth", "f.returns"
    )


def file_max_cc(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    top = E.array_max(E.transform(E.col("fns"), lambda f: f["cyclomaticComplexity"]))
    return with_functions(files, profile, ("cc",)).select(
        "file_id", E.greatest(1, top).alias("maxComplexity").column
    )


def case_counts(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    d = dialect(profile)
    return supported(files).select(
        "file_id",
        "language",
        findings.case_count(CODE, LANG, d).alias("caseCount").column,
    )


def decision_counts(files: DataFrame, language: str, profile: str | Dialect = CORE) -> DataFrame:
    """One column per decision kind for one syntax family."""
    d = dialect(profile)
    family = PY if language == "python" else JS
    wanted = LANG == "python" if family == PY else LANG != "python"
    return (
        supported(files)
        .filter(wanted.column)
        .select("file_id", strip_family(CODE, family, d).alias("clean").column)
        .select("file_id", metrics.decision_counts(E.col("clean"), family, d).alias("k").column)
        .select("file_id", "k.*")
    )
