"""Toxicity: a linear classifier over character n-grams scaled by log-count ratios.

Features are the n-grams (bytes of the lower-cased text) that occur in a text,
hashed. Their naive Bayes log-count ratio between toxic and clean texts is
computed in Spark over the learning rows; a feature enters the linear model
scaled by it. The model is a logistic regression over all features whose ratio is
significant, and its output is the score.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcgauge.llm.common import (
    mixed, remainder, slices, small_batches, stored, texts_of, with_columns,
)

SIZES = (5, 6, 7, 8)
BUCKET_BITS = 20
#: Labelled rows learned from at most, chosen by a hash of the document's id.
LEARN_ROWS = 20_000
#: A feature is used if its likelihood ratio statistic (chi-squared with one degree
#: of freedom) is so large.
SIGNIFICANT = 13.0
#: Occurrences of features in learning rows up to which the driver does the gradient
#: steps (some 6 bytes each); beyond it each step is a job over the stored rows.
HELD_OCCURRENCES = 16_000_000
#: Weights that one row of a step's partial sums holds.
SUMMED_AT_ONCE = 1 << 16
LEARN_STEPS = 400
PENALTY = 1e-5
THRESHOLD = 0.7
STEP_BYTES = 1 << 20
#: Stands between texts; n-grams that hold it do not count.
BREAK = b"\x00"


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n-gram size: (text number, bucket) of every n-gram of the texts."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(BREAK.join(raw) + BREAK, np.uint8)
    text = np.repeat(np.arange(len(raw)), [len(r) + 1 for r in raw])
    letters = mixed(np.arange(256) + 1)[data]
    stop = data == 0
    hashes, broken = letters, stop
    for size in range(2, max(SIZES) + 1):
        n = len(data) - size + 1
        if n <= 0:
            return
        hashes = hashes[:n] * np.uint64(0x9E3779B97F4A7C15) + letters[size - 1 :]
        broken = broken[:n] | stop[size - 1 :]
        if size in SIZES:
            bucket = (mixed(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
            whole = ~broken
            yield text[:n][whole], bucket[whole]


def features(texts: list[str], used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs, of the buckets in ``used``."""
    found = [np.empty(0, np.int64)]
    for text, bucket in _grams(texts):
        some = used[bucket]
        found.append(text[some].astype(np.int64) << BUCKET_BITS | bucket[some])
    pairs = np.unique(np.concatenate(found))
    return pairs >> BUCKET_BITS, (pairs & ((1 << BUCKET_BITS) - 1)).astype(np.int32)


def occurrences(texts: list[str]) -> Iterator[np.ndarray]:
    """Per text the distinct buckets of all its n-grams, by marking them."""
    marks = np.zeros(1 << BUCKET_BITS, bool)
    grams = [
        (bucket, np.searchsorted(text, np.arange(len(texts) + 1))) for text, bucket in _grams(texts)
    ]
    for i in range(len(texts)):
        for bucket, edge in grams:
            marks[bucket[edge[i] : edge[i + 1]]] = True
        found = np.flatnonzero(marks)
        marks[found] = False
        yield found


@dataclass
class Model:
    #: Weight of each bucket: the learned one times the log-count ratio.
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        text, bucket = features(texts, self.weights != 0)
        sums = np.bincount(text, weights=self.weights[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -40, 40)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: in how many toxic and clean texts each bucket occurs."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in slices(batches, "text", STEP_BYTES):
        labels = batch.column("toxic").to_pylist()
        for label, found in zip(labels, occurrences(texts_of(batch, "text")), strict=True):
            counts[label][found] += 1
    at = np.flatnonzero(counts.any(axis=0))
    for some in np.array_split(at, max(1, len(at) // 100_000)):
        yield pa.RecordBatch.from_pydict(
            {"bucket": some.astype(np.int32), "clean": counts[0][some], "toxic": counts[1][some]}
        )


@dataclass
class Block:
    """Some learning rows and the numbers of the features that occur in them."""

    labels: np.ndarray
    #: Features, one row after another; the rows that have some, and where each begins.
    columns: np.ndarray
    some: np.ndarray
    starts: np.ndarray
    #: Rows, one feature after another; the features, and where each begins.
    rows: np.ndarray
    present: np.ndarray
    firsts: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, labels: np.ndarray) -> Block:
        """From the pairs (row, feature) that occur, ordered by row."""
        order = np.argsort(columns, kind="stable")
        some, starts = np.unique(rows, return_index=True)
        present, firsts = np.unique(columns[order], return_index=True)
        number = np.min_scalar_type(max(1, len(labels)))
        return cls(labels, columns, some, starts, rows[order].astype(number), present, firsts)

    def add(self, weights: np.ndarray, learning: bool, sums: np.ndarray) -> None:
        """Add to each feature's sum the outputs of its rows, or their errors when
        learning; the last weight and sum are the bias's."""
        out = np.full(len(self.labels), weights[-1])
        if len(self.columns):
            out[self.some] += np.add.reduceat(weights[self.columns], self.starts)
        if learning:
            out = 1 / (1 + np.exp(-np.clip(out, -40, 40))) - self.labels
        sums[-1] += out.sum()
        if len(self.columns):
            sums[self.present] += np.add.reduceat(out[self.rows], self.firsts)


def _held_sums(seen: DataFrame) -> Callable[[np.ndarray, bool], np.ndarray]:
    """Sums over all blocks, which the driver holds; it reads one split at a time."""
    blocks = [pickle.loads(r.block) for r in seen.select("block").toLocalIterator()]

    def summed(weights: np.ndarray, learning: bool) -> np.ndarray:
        sums = np.zeros(len(weights))
        for block in blocks:
            block.add(weights, learning, sums)
        return sums

    return summed


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(sums) for sums in pdf["sums"])
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "sums": [total.tobytes()]})


def _spread_sums(seen: DataFrame) -> Callable[[np.ndarray, bool], np.ndarray]:
    """The same in a job: partial sums of each split, added up by part of the weights,
    so that the driver gets one vector."""
    context = seen.sparkSession.sparkContext

    def summed(weights: np.ndarray, learning: bool) -> np.ndarray:
        shared = context.broadcast(weights)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(shared.value))
            for batch in batches:
                for block in batch.column("block"):
                    pickle.loads(block.as_py()).add(shared.value, learning, sums)
            parts = [sums[i : i + SUMMED_AT_ONCE] for i in range(0, len(sums), SUMMED_AT_ONCE)]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(range(len(parts)), pa.int32()),
                    "sums": pa.array([x.tobytes() for x in parts], pa.binary()),
                }
            )

        schema = "part int, sums binary"
        found = seen.select("block").mapInArrow(partial, schema)
        found = found.groupBy("part").applyInPandas(_added, schema).collect()
        shared.destroy()
        return np.concatenate([np.frombuffer(r.sums) for r in sorted(found)])

    return summed


def fit(
    summed: Callable[[np.ndarray, bool], np.ndarray],
    n: int, toxic: int, occurring: int, ratios: np.ndarray,
) -> tuple[np.ndarray, float]:
    """Logistic regression over x * ratio by accelerated gradient steps: (weights, bias).

    ``summed`` gives the sums of ``Block.add`` over the ``n`` rows, of which ``toxic``
    are toxic and in which features occur ``occurring`` times. Weights start from one
    common value, naive Bayes' own, and a squared penalty spreads weight over
    features that occur together.
    """
    values = np.append(ratios, 1.0)

    def mean(w: np.ndarray, learning: bool) -> np.ndarray:
        return values * summed(values * w, learning) / n

    top = np.ones(len(values))
    for _ in range(20):  # the largest curvature
        top = mean(top / np.sqrt((top**2).sum()), False)
    rate = 1 / (0.3 * np.sqrt((top**2).sum()) + PENALTY)
    first = 1 / max(1.0, (occurring + n) / n)
    weights = np.append(np.full(len(ratios), first), np.log(toxic / (n - toxic)))
    looked = weights
    for step in range(LEARN_STEPS):
        pull = PENALTY * looked
        pull[-1] = 0
        new = looked - rate * (mean(looked, True) + pull)
        looked = new + step / (step + 3) * (new - weights)
        weights = new
    return weights[:-1], float(weights[-1])


def train(
    docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS,
    held_occurrences: int = HELD_OCCURRENCES,
) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic), both already without held rows.

    At most about ``learn_rows`` labelled rows are used, so the joined labels and the
    learning texts are bounded. Every significant feature is used; the driver gets
    one weight a bucket at most and ``held_occurrences`` numbers. Without rows of both
    classes every score is the share of toxic rows.
    """
    total = labels.count()
    share = min(1.0, learn_rows / max(1, total))
    picked = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = stored(
        small_batches(docs).join(F.broadcast(picked), "doc_id")  # bounded by learn_rows
        .select("text", "toxic")
        .repartition(12),
        "toxicity",
    )
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    if not (clean and toxic):
        rate = (toxic + 0.5) / (clean + toxic + 1)
        return Model(weights, float(np.log(rate / (1 - rate))))
    counted = (
        rows.mapInArrow(_count, "bucket int, clean long, toxic long")
        .groupBy("bucket")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    p, q = (F.col("toxic") + 0.5) / (toxic + 1), (F.col("clean") + 0.5) / (clean + 1)
    share = toxic / (toxic + clean)

    def gain(part: str, rate: float) -> Column:
        expected = (F.col("toxic") + F.col("clean")) * rate
        return F.when(F.col(part) > 0, F.col(part) * F.log(F.col(part) / expected)).otherwise(0.0)

    gains = 2 * (gain("toxic", share) + gain("clean", 1 - share))
    found = (
        counted.select("bucket", F.log(p / q).alias("ratio"), gains.alias("gain"))
        .filter(F.col("gain") >= SIGNIFICANT)
        .select("bucket", "ratio")
        .toArrow()  # a number a bucket at most
        .sort_by("bucket")
    )
    if not len(found):
        return Model(weights, float(np.log(toxic / clean)))
    buckets, ratios = found["bucket"].to_numpy(), found["ratio"].to_numpy()
    number = np.full(1 << BUCKET_BITS, -1, np.int32)
    number[buckets] = np.arange(len(buckets))

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = number >= 0
        for batch in slices(batches, "text", STEP_BYTES):
            text, bucket = features(texts_of(batch, "text"), used)
            labels = batch.column("toxic").to_numpy().astype(np.float64)
            block = pickle.dumps(Block.of(text, number[bucket], labels), protocol=5)
            yield pa.RecordBatch.from_pydict({"occurring": [len(text)], "block": [block]})

    seen = stored(rows.mapInArrow(occurring, "occurring long, block binary"), "toxic-features")
    many = seen.agg(F.sum("occurring")).first()[0] or 0
    summed = (_held_sums if many <= held_occurrences else _spread_sums)(seen)
    learned, bias = fit(summed, clean + toxic, toxic, many, ratios)
    weights[buckets] = learned * ratios
    return Model(weights, bias)


def score(
    docs: DataFrame, model: Model, text_col: str = "text", passed: tuple[str, ...] = ()
) -> DataFrame:
    """Per row the columns ``passed`` and the toxicity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = small_batches(docs).select(*passed, F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", STEP_BYTES):
            found = pa.array(shared.value.scores(texts_of(batch, "_text")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passed), found], [*passed, "toxicity"]
            )

    return docs.mapInArrow(run, with_columns(docs.select(*passed).schema, "toxicity double"))


def learned(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1,
    learn_rows: int = LEARN_ROWS,
) -> Model:
    """A model from the labelled rows of (doc_id, text) outside the held fold."""
    held = remainder("doc_id", folds) == held_fold
    marked = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    return train(docs.filter(~held), marked, learn_rows)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 3,
    held_fold: int = 1,
    threshold: float = THRESHOLD,
    learn_rows: int = LEARN_ROWS,
) -> DataFrame:
    """Learn from labelled documents outside the held fold and score all rows.

    Result: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).
    ``labels`` has the id and ``toxic`` (0 or 1; other values and nulls are left
    out; of several labels of one id the largest counts). A null or empty text has
    no features and gets the model's base score; a null id is in the fold of the
    empty text and never labelled. Repeated rows are scored, and learned from, as
    often as they occur. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), "toxic")
    model = learned(rows, marks, folds, held_fold, learn_rows)
    return score(rows, model, passed=("doc_id",)).select(
        "doc_id", (remainder("doc_id", folds) == held_fold).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= threshold).cast("int").alias("predicted"),
    )
