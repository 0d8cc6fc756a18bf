"""What change-only emission keeps between micro-batches: each key's last value."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, FloatType, TimestampNTZType, TimestampType

#: Columns of what the state tells of a key and a batch.
KEY, ORDER, VALUE, BEFORE = "_key", "_order", "_value", "_before"

#: Keyed state that is written as changes, so that a batch costs what its keys cost.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """A query that is started inside keeps these settings; the session gets its own back."""
    before = {name: spark.conf.get(name, None) for name in _STORE}
    for name, wanted in _STORE.items():
        spark.conf.set(name, wanted)
    try:
        yield
    finally:
        for name, old in before.items():
            if old is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, old)


def exact(*columns: str) -> Column:
    """Values as one text that is equal for equal values, nulls among them."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def plain(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns whose text in ``exact`` keeps them whole: times to the microsecond, one zero."""
    for name in names:
        kind = df.schema[name].dataType
        if isinstance(kind, TimestampType):
            df = df.withColumn(name, F.unix_micros(name))
        elif isinstance(kind, TimestampNTZType):
            df = df.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        elif isinstance(kind, (DoubleType, FloatType)):
            df = df.withColumn(name, F.when(F.col(name) == 0, F.lit(0.0)).otherwise(F.col(name)))
    return df


def _place(text: str) -> tuple:
    """The order of a row, from its text: numbers exactly, null first."""
    values = json.loads(text, parse_float=Decimal).values()
    return tuple((v is not None, v) for v in values)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A key's first row of a batch with its last value before; the new one is kept."""
    first = last = None
    for pdf in frames:
        for order, value in zip(pdf[ORDER], pdf[VALUE]):
            place = _place(order)
            if first is None or place < first[0]:
                first = place, order
            if last is None or place >= last[0]:
                last = place, value
    before = state.get[0] if state.exists else None
    if before != last[1]:
        state.update((last[1],))
    yield pd.DataFrame({KEY: [key[0]], ORDER: [first[1]], BEFORE: [before]})


def _ends(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first and the last row of each key in each Arrow batch."""
    sort = [(key, "ascending"), *((o, "ascending") for o in order if o != key)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = pc.sort_indices(batch, sort_keys=sort, null_placement="at_start")
            batch = batch.take(places)
            keys = batch.column(key).dictionary_encode(null_encoding="encode").indices
            first = np.flatnonzero(np.diff(keys.to_numpy(zero_copy_only=False), prepend=-1))
            last = np.append(first[1:], batch.num_rows) - 1
            yield batch.take(pa.array(np.union1d(first, last)))

    return df.mapInArrow(run, df.schema)


def openings(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """One row per key of a micro-batch: ``KEY``, ``ORDER`` of its first row, and ``BEFORE``,
    its last value in the batches before, null for a new key; all as ``exact`` texts."""
    fields = [key, *dict.fromkeys(c for c in (*order, value) if c != key)]
    told = plain(_ends(df.select(*fields), key, order), fields).select(
        exact(key).alias(KEY), exact(*order).alias(ORDER), exact(value).alias(VALUE)
    )
    return told.groupBy(KEY).applyInPandasWithState(
        _advance, f"{KEY} string, {ORDER} string, {BEFORE} string", "value string", "update",
        GroupStateTimeout.NoTimeout,
    )
