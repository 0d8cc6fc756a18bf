"""Per-file operators: gates, line operators, tokens and the file summary.

All are projections of one input row, except the two token aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import metrics as M
from ..functions import sqltext as E
from ..functions import text as T
from ..functions.arrays import let, run_lengths
from ..functions.dialect import CORE, Dialect, dialect
from ..functions.sqltext import Expr

CODE, LANG = E.col("code"), E.col("language")


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", T.language_detect(E.col("filename")).column)


def supported(files: DataFrame) -> DataFrame:
    """Files of a known language; the test reads the file name only."""
    return with_language(files).filter((LANG != "unknown").column)


def unsupported(files: DataFrame) -> DataFrame:
    """Error rows for files of no known language."""
    return (
        with_language(files)
        .filter((LANG == "unknown").column)
        .select("file_id", F.lit(fixed.UNSUPPORTED).alias("error"), "language")
    )


def analyzable(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Supported files whose code is not blank."""
    d = dialect(profile)
    return supported(files).filter((E.length(T.ltrim_space(CODE, d)) > 0).column)


def lines(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """One row per line with its number and class."""
    d = dialect(profile)
    return (
        supported(files)
        .select("file_id", "language", F.posexplode(T.line_split(CODE).column).alias("pos", "text"))
        .select(
            "file_id",
            (F.col("pos") + 1).alias("line"),
            "text",
            T.line_class(E.col("text"), LANG, d).alias("line_class").column,
        )
    )


def clean_files(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    d = dialect(profile)
    return supported(files).select(
        "file_id", "language", T.strip_noise(CODE, LANG, d).alias("clean").column
    )


def tokens(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """One row per token, in order."""
    d = dialect(profile)
    return clean_files(files, d).select(
        "file_id",
        "language",
        F.posexplode(M.token_extract(E.col("clean"), d).column).alias("pos", "token"),
    )


def classified_tokens(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    return tokens(files, profile).select(
        "file_id", "pos", "token", M.token_class(E.col("token"), LANG).alias("token_class").column
    )


def token_freq(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Count per file, class and token of operators and operands.

    A file's tokens are in its row, so they are sorted and counted there; a token is
    classified once and is one row, and nothing is shuffled.
    """
    d = dialect(profile)
    runs = run_lengths(E.sort_array(M.token_extract(E.col("clean"), d)))
    counted = clean_files(files, d).select(
        "file_id", "language", F.explode_outer(runs.column).alias("t")
    )
    classed = counted.filter(F.col("t").isNotNull()).select(
        "file_id", M.token_class(E.col("t.value"), LANG).alias("token_class").column,
        F.col("t.value").alias("token"), F.col("t.n").cast("bigint").alias("n"),
    )
    return classed.filter(F.col("token_class") != "ignored")


def token_totals(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Distinct and total operators and operands per file, without a shuffle."""
    d = dialect(profile)
    return (
        clean_files(files, d)
        .select("file_id", M.token_totals(E.col("clean"), LANG, d).alias("t").column)
        .select("file_id", "t.*")
    )


def summary_struct(
    code: Expr,
    lang: Expr,
    function_count: Expr | None,
    d: Dialect = CORE,
    whole: Expr | None = None,
) -> Expr:
    """The summary of one file; the stripped text is built once, or not at all if the
    file's own metrics ``whole`` are known from its function table."""

    def family(fam: str) -> Expr:
        return let(
            T.strip_family(code, fam, d),
            lambda clean: E.struct(
                M.cyclomatic_clean(clean, fam, d).alias("cc"),
                M.halstead_clean(clean, fam, d).alias("halstead"),
            ),
        )

    measured = E.struct(
        T.line_counts(code, lang, d).alias("lines"),
        (T.by_language(lang, family(T.PY), family(T.JS)) if whole is None else whole).alias("m"),
    )

    def of(x: Expr) -> Expr:
        counts, m = x["lines"], x["m"]
        mi = M.maintainability(m["halstead"]["volume"], m["cc"], counts["loc"], d)
        return let(
            mi,
            lambda v: E.struct(
                *(counts[k].alias(k) for k in ("loc", "sloc", "blankLines", "commentLines")),
                *([] if function_count is None else [function_count.alias("functionCount")]),
                m["cc"].alias("cyclomaticComplexity"),
                M.cc_level(m["cc"]).alias("complexityLevel"),
                v.alias("maintainabilityIndex"),
                M.mi_level(v).alias("maintainabilityLevel"),
                m["halstead"].alias("halstead"),
            ),
        )

    return let(measured, of)


def file_summary(files: DataFrame, profile: str | Dialect = CORE) -> DataFrame:
    """Counts, complexity, Halstead and maintainability per file, no functions."""
    d = dialect(profile)
    return (
        supported(files)
        .select("file_id", "filename", "language", summary_struct(CODE, LANG, None, d).alias("s").column)
        .select("file_id", "filename", "language", "s.*")
    )
