"""Analysis history and latest-value operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed

HISTORY_DDL = (
    "id string, filename string, loc int, complexity int, maintainability double, "
    "functionCount int, issueCount int, timestamp timestamp, day date, language string"
)
RECORD_FIELDS = (
    "id",
    "filename",
    "language",
    "loc",
    "complexity",
    "maintainability",
    "functionCount",
    "issueCount",
    "timestamp",
)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def history_records(analysis: DataFrame, timestamp: Column) -> DataFrame:
    """Flat records of analysed files. The id is a hash, so reruns agree. A file whose
    findings fill several documents has one record."""
    return analysis.filter("part = 0").select(
        F.sha2(
            F.concat_ws("|", F.col("file_id").cast("string"), "filename", iso_utc(timestamp)), 256
        ).alias("id"),
        "filename",
        "language",
        F.col("summary.loc").alias("loc"),
        F.col("summary.cyclomaticComplexity").alias("complexity"),
        F.col("summary.maintainabilityIndex").alias("maintainability"),
        F.col("summary.functionCount").alias("functionCount"),
        "issueCount",
        timestamp.alias("timestamp"),
    )


def append_history(records: DataFrame, path: str) -> None:
    """Append to the history table, partitioned by day and language.

    The rebalance hint lets AQE split a large partition and merge small ones,
    so files come out evenly sized.
    """
    (
        records.withColumn("day", F.to_date("timestamp"))
        .hint("rebalance", "day", "language")
        .write.mode("append")
        .partitionBy("day", "language")
        .parquet(path)
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_DDL).parquet(path)


def history_top(records: DataFrame, n: int = fixed.HISTORY_PAGE) -> DataFrame:
    """The newest records; ties by id."""
    return records.orderBy(F.desc("timestamp"), "id").limit(n)


def _days(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """The day folders of a history, newest first; rows without a day come last."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[str]] = {}
    for pattern in ("day=*", "batch=*/day=*"):
        for status in files.globStatus(hadoop.Path(place, pattern)) or []:
            folder = status.getPath()
            found.setdefault(folder.getName().removeprefix("day="), []).append(folder.toString())
    dated = sorted((d for d in found if d[:1].isdigit()), reverse=True)
    return [(d, found[d]) for d in (*dated, *(d for d in found if not d[:1].isdigit()))]


def newest_history(spark: SparkSession, path: str, n: int = fixed.HISTORY_PAGE) -> DataFrame:
    """The newest records of a stored history; ties by id.

    Days are looked at from the newest on, twice as many each time, until they hold ``n``
    records, which the files' footers tell. Older days are not read, however many there are.
    """
    days = _days(spark, path)
    taken, step = 0, 1
    while True:
        taken = min(len(days), taken + step)
        chosen = [folder for _, folders in days[:taken] for folder in folders]
        reader = spark.read.schema(HISTORY_DDL).option("basePath", path)
        records = reader.parquet(*chosen) if chosen else spark.createDataFrame([], HISTORY_DDL)
        if taken == len(days) or records.count() >= n:
            return history_top(records, n)
        step *= 2


def latest(df: DataFrame, key: str, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key, combined map-side so a hot key shuffles one row per task."""
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*values), F.struct(*order)).alias("last"))
        .select(key, "last.*")
    )


def current_or_last(
    current: DataFrame, stored: DataFrame, key: str, value: str, order: Sequence[str]
) -> DataFrame:
    """The current value of each key, else the last stored one."""
    cur = latest(current, key, [value], order).withColumnRenamed(value, "current_value")
    last = latest(stored, key, [value], order).withColumnRenamed(value, "last_value")
    return last.join(cur, key, "left").select(
        key,
        F.coalesce("current_value", "last_value").alias(value),
        F.col("current_value").isNotNull().alias("is_current"),
    )


def even_buckets(df: DataFrame, order: str, buckets: int) -> Column:
    """A bucket for ``change_only`` that rises with a column and holds about as many rows
    as any other, wherever they are: cuts are quantiles of the whole column.

    So one key with all rows of a day is split over the buckets too. Rows of one value stay
    together; a null is in the first bucket, as it comes first.
    """
    if buckets < 2:
        return F.lit(0)
    shares = [i / buckets for i in range(1, buckets)]
    cuts = F.percentile_approx(F.col(order), F.array(*map(F.lit, shares)), F.lit(100 * buckets))
    found = sorted(set(df.agg(cuts.alias("cuts")).first()["cuts"] or []))
    if not found:
        return F.lit(0)
    above = F.filter(F.array(*map(F.lit, found)), lambda cut: cut < F.col(order))
    return F.coalesce(F.size(above), F.lit(0))


def change_only(
    df: DataFrame, key: str, value: str, order: Sequence[str], bucket: Column
) -> DataFrame:
    """Rows whose value differs from the key's previous one; the first is kept.

    ``bucket`` must rise with the order (a day, or ``even_buckets``). Each (key, bucket) is compared on its
    own and only its last value is handed to the next bucket, so a hot key is
    split over its buckets. Rows without a key are compared with one another.
    """
    staged = df.withColumn("_bucket", bucket).withColumn("_key", F.struct(key))
    inside = Window.partitionBy("_key", "_bucket").orderBy(*order)
    compared = staged.withColumn("_prev", F.lag(F.struct(value)).over(inside))
    ends = staged.groupBy("_key", "_bucket").agg(
        F.max_by(F.struct(value), F.struct(*order)).alias("_end")
    )
    carried = ends.withColumn(
        "_carried", F.lag("_end").over(Window.partitionBy("_key").orderBy("_bucket"))
    ).drop("_end")
    previous = F.coalesce("_prev", "_carried")
    return (
        compared.join(carried, ["_key", "_bucket"])  # a struct of a null equals another
        .filter(previous.isNull() | ~previous[value].eqNullSafe(F.col(value)))
        .select(*df.columns)
    )
