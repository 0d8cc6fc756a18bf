"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from srcgauge.streaming.shared import fresh_folder

#: Rows of one Arrow batch that a task handles at once, and their text bytes.
SLICE_ROWS = 2_000
SLICE_BYTES = 8 << 20
#: Bytes of the Arrow batches that go to and from Python workers.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Have Spark send ``df`` to Python in batches of a few MB, whatever its texts' sizes.

    This is a setting of the session, since plans read it when they run: executors
    hold several batches per task beside the heap.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later jobs start from the files, so a lost executor repeats only its own
    reads, and values drawn in a task (a row's place in its split) stay as they
    are. The files are deleted when the application ends.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, purpose)
    df.write.options(**options).parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def slices(
    batches: Iterator[pa.RecordBatch], text: str | None = None, most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a step holds about ``most`` bytes of text, or one text."""
    for batch in batches:
        step = SLICE_ROWS
        if text is not None and batch.num_rows:
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
            ends = np.cumsum(sizes.astype(np.int64))
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = int(np.searchsorted(ends, before + most, side="right"))
                stop = min(max(start + 1, stop), start + step)
                yield batch.slice(start, stop - start)
                start = stop
            continue
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; a null is an empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of a key written as text, modulo ``modulus``; a null key counts as ''."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all their bits (a one-to-one map)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def with_columns(schema: StructType, more: str) -> StructType:
    """A schema and more fields, written as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
PLACE_BITS = 33


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Add ``name``: the rows' places from 0 in a total order, without one task holding them.

    The sorted rows are written once with their partition and their place in it; the
    driver sees one row count per partition. ``order`` must tell all rows apart.
    """
    at = F.monotonically_increasing_id()
    placed = stored(df.orderBy(*order).withColumn("_place", at), name)
    part = F.shiftright("_place", PLACE_BITS)
    counts = placed.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    first = np.cumsum([0, *[r["count"] for r in counts]]).tolist()
    offsets = df.sparkSession.createDataFrame(
        [(r["_part"], f) for r, f in zip(counts, first)], "_part long, _first long"
    )
    within = F.col("_place").bitwiseAND((1 << PLACE_BITS) - 1)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_first") + within)
        .drop("_part", "_first", "_place")
    )
