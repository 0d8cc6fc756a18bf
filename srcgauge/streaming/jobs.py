"""Streaming forms of the analysis and of the latest-value operators.

Every sink writes one folder per micro-batch and replaces the whole folder on a
retry, so a lost executor or a restarted query leaves no duplicate rows, whatever
partitions the first try wrote. What a batch needs of the batches before it is in
Spark's state store (change-only) or in a bucketed table (latest values).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.history import change_only, history_records
from ..plans.analysis import analyze
from .state import BEFORE, KEY, ORDER, exact, keyed_state, openings, plain
from .store import LatestStore


def stream_table(spark: SparkSession, path: str, schema: str, max_files: int = 1_000) -> DataFrame:
    """A parquet table, or a folder that parquet files arrive in, as a stream.

    The path is given as a pattern matching itself: a plain path has to be a
    folder, a pattern may also name a single file.
    """
    path = path.rstrip("/")
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .parquet(f"{path[:-1]}[{path[-1]}]")
    )


def _write_batch(df: DataFrame, batch: int, path: str, by: Sequence[str] = ()) -> None:
    """Replace the folder of a batch; the reader finds ``batch`` as a partition."""
    if by:
        df = df.hint("rebalance", *by)
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*by)
        .parquet(f"{path}/batch={batch}")
    )


def _make_folder(spark: SparkSession, path: str) -> None:
    """So that a stream without a batch can be read as an empty table."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)


def _start(
    df: DataFrame, each, checkpoint: str, trigger: Mapping[str, object], mode: str = "append"
) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


#: What is there is read, then the query ends; {"processingTime": "10 seconds"} goes on.
ALL_AVAILABLE: Mapping[str, object] = {"availableNow": True}


def stream_analyze(
    files: DataFrame,
    history_path: str,
    checkpoint: str,
    timestamp: Column | None = None,
    profile: str = "core",
    trigger: Mapping[str, object] = ALL_AVAILABLE,
) -> StreamingQuery:
    """Analyse arriving files and keep their history records."""
    _make_folder(files.sparkSession, history_path)
    stamp = F.current_timestamp() if timestamp is None else timestamp

    def each(batch: DataFrame, number: int) -> None:
        records = history_records(analyze(batch, profile), stamp)
        _write_batch(
            records.withColumn("day", F.to_date("timestamp")),
            number,
            history_path,
            ("day", "language"),
        )

    return _start(files, each, checkpoint, trigger)


def stream_latest(
    df: DataFrame,
    key: str,
    values: Sequence[str],
    order: Sequence[str],
    path: str,
    checkpoint: str,
    trigger: Mapping[str, object] = ALL_AVAILABLE,
    buckets: int = 64,
) -> StreamingQuery:
    """Running latest values per key in a ``LatestStore``: about one row a key on disk.

    A batch is reduced to its own keys first, which combines map-side, so a hot key costs
    one row; then only the buckets of its keys are touched. ``buckets`` holds for a new
    table; one that is there keeps its number.
    """
    _make_folder(df.sparkSession, path)

    def each(batch: DataFrame, number: int) -> None:
        LatestStore(batch.sparkSession, path, key, values, order).merge(batch, number, buckets)

    return _start(df, each, checkpoint, trigger)


def read_latest(
    spark: SparkSession, path: str, key: str, values: Sequence[str], order: Sequence[str],
    schema: str | StructType | None = None,
) -> DataFrame:
    """The last row of each key after the newest whole batch. With the stored columns'
    ``schema`` a stream without a batch reads as empty."""
    found = LatestStore(spark, path, key, values, order).read(schema)
    if found is None:
        raise ValueError(f"no batch has been written to {path}; give a schema to read it as empty")
    return found


def stream_change_only(
    df: DataFrame,
    key: str,
    value: str,
    order: Sequence[str],
    bucket: Column,
    path: str,
    checkpoint: str,
    trigger: Mapping[str, object] = ALL_AVAILABLE,
) -> StreamingQuery:
    """Rows whose value differs from the key's previous one in order of arrival.

    Rows arrive batch by batch, and inside a batch in ``order``. A row that arrives
    late is compared with the last row that arrived before it, as a reader of the
    running values sees them. Inside a batch the batch operator does the work, so a
    hot key is split over its buckets. Between batches each key's last value is kept in
    the state store; a batch costs what its own keys cost, however many there are. The
    state operator sees the ends of each key in each Arrow batch, not all its rows.
    """
    out, columns = f"{path}/rows", df.columns
    _make_folder(df.sparkSession, out)
    both = df.unionByName(openings(df, key, value, order), allowMissingColumns=True)

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # the state is read once
        try:
            opened = batch.filter(F.col(KEY).isNotNull())
            first = opened.filter(F.col(BEFORE).isNotNull()).select(KEY, ORDER, BEFORE)
            rows = batch.filter(F.col(KEY).isNull()).select(*columns)
            changed = change_only(rows, key, value, order, bucket)
            texts = plain(changed.select(F.struct(*columns).alias("_row"), *columns), columns)
            # The first row of a key in the batch follows the last one before it.
            same = (exact(*order) == F.col(ORDER)) & (exact(value) == F.col(BEFORE))
            kept = texts.withColumn(KEY, exact(key)).join(first, KEY, "left")
            kept = kept.filter(F.col(BEFORE).isNull() | ~same).select("_row.*")
            _write_batch(kept, number, out)
        finally:
            batch.unpersist()

    with keyed_state(df.sparkSession):
        return _start(both, each, checkpoint, trigger, mode="update")


def read_changes(
    spark: SparkSession, path: str, columns: Sequence[str], schema: str | StructType | None = None
) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/rows").select(*columns)
