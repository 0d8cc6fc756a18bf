"""The given tables, read as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A session may ask for so many partitions of the texts that are analysed. It is for
#: tables that are one row group, which no split size divides; unset, nothing moves.
SPLITS = "spark.srcgauge.splits"


def dealt(scan: DataFrame) -> DataFrame:
    """The scan in as many partitions as the session asks for, if it does."""
    asked = scan.sparkSession.conf.get(SPLITS, None)
    return scan.repartition(int(asked)) if asked else scan
