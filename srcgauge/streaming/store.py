"""A table of latest values that micro-batches are merged into.

Keys are dealt into buckets by their hash. A batch writes its keys' values as one more
layer of the buckets it touches; a bucket whose layers above the first hold as many rows as
the first is written anew as a single one. So a bucket has at most about twice as many rows
as keys, and over time a value is rewritten as often as its bucket doubles, whatever the
number of keys. A manifest per batch lists each bucket's layers. It appears whole or not
at all, so a reader sees the table as it was after some batch. A batch that is tried again
starts from the manifests before it and replaces its own files.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.history import latest

#: Manifests that are kept: one for readers that have just listed it, and the newest.
KEPT = 2


class LatestStore:
    """Latest ``values`` by ``order`` of each ``key`` below a folder."""

    def __init__(
        self, spark: SparkSession, path: str, key: str, values: Sequence[str], order: Sequence[str]
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.values, self.order = key, list(values), list(order)
        self._jvm = spark.sparkContext._jvm
        place = self._place(self.path)
        self._files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._place(f"{self.path}/manifest"))

    def _place(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # -- manifests -------------------------------------------------------------------
    def _batches(self) -> list[int]:
        found = self._files.listStatus(self._place(f"{self.path}/manifest"))
        names = [f.getPath().getName() for f in found]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _read(self, batch: int) -> dict:
        stream = self._files.open(self._place(f"{self.path}/manifest/{batch}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, batch: int, manifest: dict) -> None:
        """Put the manifest there by a rename, so that no reader sees a part of it."""
        draft = self._place(f"{self.path}/manifest/{batch}.draft")
        final = self._place(f"{self.path}/manifest/{batch}.json")
        stream = self._files.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        self._files.delete(final, False)
        if not self._files.rename(draft, final):
            raise OSError(f"could not publish {final.toString()}")

    # -- reading ---------------------------------------------------------------------
    def _layers(self, manifest: dict, buckets: Sequence[str] | None = None) -> list[str]:
        chosen = manifest["layers"] if buckets is None else {b: manifest["layers"].get(b, []) for b in buckets}
        return [f"{self.path}/data/batch={n}/bucket={b}" for b, ls in chosen.items() for n, _ in ls]

    def read(self, schema=None) -> DataFrame | None:
        """The table after the newest batch; None (or, with a schema, empty) before the first."""
        batches = self._batches()
        paths = self._layers(self._read(batches[-1])) if batches else []
        if not paths:
            return None if schema is None else self._latest(self.spark.createDataFrame([], schema))
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return self._latest(reader.parquet(*paths))

    def _latest(self, rows: DataFrame) -> DataFrame:
        return latest(rows, self.key, self.values, self.order)

    # -- merging ---------------------------------------------------------------------
    def merge(self, rows: DataFrame, batch: int, buckets: int) -> None:
        """Merge rows (key, values, order) as batch number ``batch``."""
        before = [b for b in self._batches() if b < batch]
        old = self._read(before[-1]) if before else {"buckets": buckets, "layers": {}}
        buckets = old["buckets"]  # a table keeps the number it began with
        columns = [self.key, *dict.fromkeys([*self.order, *self.values])]
        others = [c for c in columns[1:] if c not in self.order]
        place = F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")
        rows = rows.select(*columns)
        new = latest(rows, self.key, [*self.order, *others], self.order).select(*columns)
        new = new.withColumn("bucket", place).persist()
        try:
            counts = {str(r["bucket"]): r["count"] for r in new.groupBy("bucket").count().collect()}
            layers = {b: list(map(list, ls)) for b, ls in old["layers"].items()}
            full = [b for b, n in counts.items() if self._is_full(layers.get(b, []), n)]
            if full:
                paths = self._layers(old, full)
                known = self.spark.read.schema(rows.schema).parquet(*paths)
                touched = new.filter(F.col("bucket").cast("string").isin(full)).select(*columns)
                merged = latest(
                    known.unionByName(touched), self.key, [*self.order, *others], self.order
                ).select(*columns)
                rest = new.filter(~F.col("bucket").cast("string").isin(full))
                out = rest.unionByName(merged.withColumn("bucket", place))
            else:
                out = new
            self._write(out, batch)
        finally:
            new.unpersist()
        if full:  # a layer's rows are counted from what was written
            schema = StructType([*rows.schema.fields, StructField("bucket", IntegerType())])
            written = self.spark.read.schema(schema).parquet(f"{self.path}/data/batch={batch}")
            counts = {str(r["bucket"]): r["count"] for r in written.groupBy("bucket").count().collect()}
        for b, n in counts.items():
            layers[b] = [[batch, n]] if b in full else [*layers.get(b, []), [batch, n]]
        self._publish(batch, {"batch": batch, "buckets": buckets, "layers": layers})
        self._forget(batch)

    @staticmethod
    def _is_full(layers: list[list[int]], more: int) -> bool:
        return bool(layers) and sum(n for _, n in layers[1:]) + more >= layers[0][1]

    def _write(self, rows: DataFrame, batch: int) -> None:
        (
            rows.hint("rebalance", "bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy("bucket")
            .parquet(f"{self.path}/data/batch={batch}")
        )

    def _forget(self, batch: int) -> None:
        """Delete the oldest manifests, and the layers that only they list."""
        batches = [b for b in self._batches() if b <= batch]
        gone, kept = batches[:-KEPT], batches[-KEPT:]
        if not gone:
            return
        live = {p for b in kept for p in self._layers(self._read(b))}
        for b in gone:
            for path in self._layers(self._read(b)):
                if path not in live:
                    self._files.delete(self._place(path), True)
            self._files.delete(self._place(f"{self.path}/manifest/{b}.json"), False)
