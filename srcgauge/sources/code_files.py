"""Reading code files into ``(file_id, filename, code)`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

SUBMISSION_DDL = "file_id string, filename string, code string"


def drop_cr(code: Column) -> Column:
    return F.replace(code, F.lit("\r"), F.lit(""))


def submissions(df: DataFrame) -> DataFrame:
    """Accepted rows: code present, file name defaulted, carriage returns gone."""
    return df.filter(F.col("code").isNotNull()).select(
        "file_id",
        F.coalesce(F.col("filename"), F.lit(fixed.DEFAULT_FILENAME)).alias("filename"),
        drop_cr(F.col("code")).alias("code"),
    )


def rejected_submissions(df: DataFrame) -> DataFrame:
    """Rows without code."""
    return df.filter(F.col("code").isNull()).select(
        "file_id", "filename", F.lit("missing field: code").alias("error")
    )


def read_submissions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Submissions stored as parquet, orc or json with the fixed schema."""
    return spark.read.schema(SUBMISSION_DDL).format(fmt).load(path)


def read_source_tree(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One row per file below ``path``; the id is the file's path."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive)
    return _from_text(raw)


def stream_source_tree(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame:
    """The same rows as a stream of arriving files."""
    arriving = spark.readStream.option("maxFilesPerTrigger", max_files)
    return _from_text(arriving.text(path, wholetext=True, recursiveFileLookup=True))


def _from_text(raw: DataFrame) -> DataFrame:
    return submissions(
        raw.select(
            F.col("_metadata.file_path").alias("file_id"),
            F.col("_metadata.file_name").alias("filename"),
            F.col("value").alias("code"),
        )
    )
