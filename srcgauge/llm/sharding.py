"""Uniform sharding by a hypergeometric communication matrix.

Every row goes to a shard so that each assignment with the required shard sizes
is equally likely. How many rows a part of the input sends to each block of a
shard is drawn first (a row of the communication matrix); then rows are permuted
in their part, exchanged, and permuted again in their block.

No process holds the matrix. A task draws its own row: it walks down a binary
tree over the parts and splits, at each node, the node's column totals between
the two halves with a multivariate hypergeometric draw seeded by the node. All
tasks that pass a node draw the same numbers, also when a task is repeated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from srcgauge.llm.common import stored

#: numpy draws hypergeometric numbers for populations below this.
NUMPY_LIMIT = 10**9
#: Rows of a part are permuted together; a block of a shard has as many at most.
PART_BITS = 16


def sizes_of(rows: int, shards: int) -> np.ndarray:
    """Shard sizes that differ by one at most."""
    return rows // shards + (np.arange(shards) < rows % shards).astype(np.int64)


def blocks_of(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut shards into blocks of near-equal size: (shard of a block, rows of a block)."""
    shard, rows = [], []
    for s, size in enumerate(sizes.tolist()):
        parts = sizes_of(size, max(1, -(-size // block_rows)))
        shard.append(np.full(len(parts), s))
        rows.append(parts)
    return np.concatenate(shard).astype(np.int64), np.concatenate(rows).astype(np.int64)


def _draw_one(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric number for any population: numpy below its limit, else by
    inverting the distribution around its mode."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(n, good)
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = 40 + int(12 * (n * (good / total) * (bad / total) * ((total - n) / total)) ** 0.5)
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(weights, rng.random() * weights[-1], side="right").clip(0, b - a))


def _draw(rng: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour are among n drawn without putting back."""
    total = int(colors.sum())
    if total < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(colors, n, method="marginals")
    out = np.zeros_like(colors)
    for i, good in enumerate(colors.tolist()):
        if n == 0:
            break
        total -= good
        out[i] = _draw_one(rng, good, total, n) if total else n
        n -= int(out[i])
    return out


def communication_row(part: int, counts: np.ndarray, columns: np.ndarray, seed: int) -> np.ndarray:
    """Row ``part`` of the matrix with row sums ``counts`` and column sums ``columns``."""
    low, high, colors = 0, len(counts), columns.astype(np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, 1, low, high])
        left = _draw(rng, colors, int(counts[low:mid].sum()))
        low, high, colors = (low, mid, left) if part < mid else (mid, high, colors - left)
    return colors


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has, whatever the case."""
    taken, prefix = {c.lower() for c in df.columns}, "_"
    while any(prefix + n in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def shuffle_into_shards(
    df: DataFrame, shards: int = 8, seed: int = 20, block_rows: int = 1 << PART_BITS
) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in a shard).

    The order over (shard, slot) is a uniformly random order of all rows, and
    shard sizes differ by one at most. Rows count one by one: nulls, ties and
    repeated rows need no rule, an empty table gives an empty result, and columns
    of the input named ``shard`` or ``slot`` are replaced. Other columns stay, whatever
    their names.

    The rows are written once to the shared folder with their place, so that a
    repeated task sees the same rows; then two shuffles move them. A part holds
    2^16 consecutive rows of a split and a block ``block_rows`` rows at most, so
    no task holds a whole shard. The driver sees one number per part.
    """
    df = df.drop("shard", "slot")
    schema = StructType(
        [*df.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())]
    )
    at, part_of, block_of = _fresh(df, "at", "part", "block")
    place = F.monotonically_increasing_id()
    placed = stored(
        df.withColumn(at, place).withColumn(part_of, F.shiftright(at, PART_BITS)), "shuffle"
    )
    found = sorted(tuple(r) for r in placed.groupBy(part_of).agg(F.count("*")).collect())
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    parts = np.array([p for p, _ in found], np.int64)
    counts = np.array([n for _, n in found], np.int64)
    rows = int(counts.sum())

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(np.searchsorted(parts, pdf[part_of].iloc[0]))
        _, columns = blocks_of(sizes_of(rows, shards), block_rows)
        row = communication_row(part, counts, columns, seed)
        order = np.random.default_rng([seed, 2, part]).permutation(len(pdf))
        pdf = pdf.sort_values(at, ignore_index=True).iloc[order]
        return pdf.drop(columns=part_of).assign(**{block_of: np.repeat(np.arange(len(row)), row)})

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf[block_of].iloc[0])
        shard, columns = blocks_of(sizes_of(rows, shards), block_rows)
        first = int(columns[:block][shard[:block] == shard[block]].sum())
        order = np.random.default_rng([seed, 3, block]).permutation(len(pdf))
        pdf = pdf.sort_values(at, ignore_index=True)
        return pdf.drop(columns=[at, block_of]).assign(
            shard=np.int32(shard[block]), slot=first + order
        )

    moved = StructType(
        [*df.schema.fields, StructField(at, LongType()), StructField(block_of, LongType())]
    )
    sent = placed.groupBy(part_of).applyInPandas(send, moved)
    return sent.groupBy(block_of).applyInPandas(settle, schema)
