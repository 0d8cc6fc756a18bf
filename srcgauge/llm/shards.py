"""Vectors in shards, and a query set searched against every shard in blocks.

A shard is a run of consecutive vectors of one input split, kept as one row with
its index, so building shards moves nothing and no key can be hot. Queries are
kept as blocks in the same way. Pairs of blocks and shards are dealt into tiles, a
group of blocks against a group of shards: a shard travels once for each group of
blocks, a block once for each group of shards, and a task holds a group of blocks
and one shard at a time. What leaves a tile is the best of each query in it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgauge.llm.common import small_batches, stored

SHARD_ROWS = 16_384
BLOCK_ROWS = 4_096
#: Blocks and shards of a tile, and tiles at least for each core, while there are pairs.
TILE_BLOCKS = 32
TILE_SHARDS = 64
TILES_A_CORE = 2
#: Partitions of the tiles.
MOST_PARTITIONS = 20_000
#: A row is megabytes: Parquet looks at sizes after each row, so that its writers and
#: readers hold a few.
LARGE_ROWS = {
    "parquet.block.size": str(16 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.enable.dictionary": "false",
}

SHARD = "shard long, dim int, n int, data binary"
FOUND = "block long, query_id long, vec_id long, score {kind}"
#: Below every score, by the type of scores: whole numbers stay whole.
LOWEST = {"double": -np.inf, "long": np.iinfo(np.int64).min}


def finite(vector: str | Column) -> Column:
    """A vector that takes part: not null or empty, without null, NaN or infinity."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    inf = float("inf")
    good = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf))
    )
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False))


def narrowed(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them."""
    top = np.abs(matrix).max(initial=0)
    if (matrix == np.floor(matrix)).all():
        for kind in (np.int8, np.int16, np.int32):
            if top <= np.iinfo(kind).max:
                return matrix.astype(kind)
    if top <= np.finfo(np.float32).max and (matrix.astype(np.float32) == matrix).all():
        return matrix.astype(np.float32)
    return matrix


def in_shards(
    vectors: DataFrame, build: Callable[[np.ndarray, np.ndarray, int], object], rows: int
) -> DataFrame:
    """One row per shard of (vec_id, vector array<double>): ``build(ids, matrix, shard)``
    pickled. Vectors of different lengths go to different shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def made(dim: int) -> pa.RecordBatch:
            nonlocal shard
            parts = held.pop(dim)
            ids = np.concatenate([i for i, _ in parts])
            matrix = np.concatenate([m for _, m in parts])
            data = pickle.dumps(build(ids, matrix, shard), protocol=5)
            shard += 1
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard - 1], pa.int64()),
                    "dim": pa.array([dim], pa.int32()),
                    "n": pa.array([len(ids)], pa.int32()),
                    "data": pa.array([data], pa.binary()),
                }
            )

        for batch in batches:
            column = batch.column("vector")
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            dims = np.diff(column.offsets.to_numpy())
            starts = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for some in np.array_split(at, -(-len(at) // rows)):
                    matrix = flat[starts[some][:, None] + np.arange(dim)]
                    held.setdefault(dim, []).append((ids[some], matrix))
                    if sum(len(i) for i, _ in held[dim]) >= rows:
                        yield made(dim)
        for dim in list(held):
            yield made(dim)

    return vectors.mapInArrow(run, SHARD)


Search = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]


def search_tiles(
    tiles: DataFrame, partitions: int, search: Search, k: int, kind: str = "double"
) -> DataFrame:
    """Run ``search`` for the blocks of each tile and its shards, but not a block's ``home``.

    ``tiles`` has a row per tile and block (shard null, queries = pickled (ids, matrix), the
    kth scores so far of the queries in ``known``) and per tile and shard (block null).
    ``search(index, ids, matrix, bound, k, best)`` adds to ``best``, which a block keeps
    over the shards of its tile. Arrow batches are cut by bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, blocks = None, []

        def found() -> Iterator[pa.RecordBatch]:
            for block, _, _, best in blocks:
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": np.full(len(best.at), block),
                        "query_id": best.ids[best.at],
                        "vec_id": best.found,
                        "score": best.score,
                    }
                )

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if tile != row["tile"].as_py():
                    yield from found()
                    tile, blocks = row["tile"].as_py(), []
                shard = row["shard"].as_py()
                if shard is None:
                    ids, matrix = pickle.loads(row["data"].as_buffer())
                    known = dict(zip(row["known"].as_py(), row["bounds"].as_py(), strict=True))
                    lowest = LOWEST[kind]
                    bound = np.array([known.get(q, lowest) for q in ids.tolist()], type(lowest))
                    best = Best(ids, bound, k)
                    blocks.append((row["block"].as_py(), row["home"].as_py(), matrix, best))
                    continue
                index = pickle.loads(row["data"].as_buffer())
                for _, home, matrix, best in blocks:
                    if shard != home:
                        search(index, best.ids, matrix.astype(np.float64), best.kth, k, best)
        yield from found()

    dealt = tiles.repartitionById(partitions, F.pmod("tile", F.lit(partitions)).cast("int"))
    in_order = dealt.sortWithinPartitions("tile", F.col("shard").asc_nulls_first(), "block")
    return in_order.mapInArrow(run, FOUND.format(kind=kind))


def _in_tiles(
    blocks: DataFrame, block_tiles: list[tuple], shards: DataFrame, shard_tiles: list[tuple]
) -> DataFrame:
    """A row per block or shard and tile of it: tiles are (number, first, last, step)."""
    spark = shards.sparkSession

    def each(df: DataFrame, name: str, places: list[tuple]) -> DataFrame:
        places = spark.createDataFrame(places, f"{name} long, _a long, _z long, _step long")
        tiles = F.explode(F.sequence("_a", "_z", "_step")).alias("tile")
        return df.join(F.broadcast(places), name).select("*", tiles).drop("_a", "_z", "_step")

    left = each(blocks, "block", block_tiles).withColumn("shard", F.lit(None).cast("long"))
    right = each(shards.select("shard", "data"), "shard", shard_tiles)
    return left.unionByName(right, allowMissingColumns=True)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: highest score, then smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top_rows(
    at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct ids of each query among flat (query position, id, score)."""
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    at, ids, scores = at[new], ids[new], scores[new]
    first = np.searchsorted(at, at, side="left")
    best = np.arange(len(at)) - first < k
    return at[best], ids[best], scores[best]


class Best:
    """The k best found so far for a block of queries, and each one's kth score.

    What is offered waits until it is a share of what is held; ``settle`` takes it in.
    """

    def __init__(self, ids: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.k, self.kth = ids, k, bound.copy()
        self.at = np.empty(0, np.int64)
        self.found = np.empty(0, np.int64)
        self.score = np.empty(0, bound.dtype)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.most_waiting = len(ids) * k // 4

    def offer(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of the queries ``at`` with the vectors ``ids``, as a matrix."""
        # Scores are exact in their type, so a bound rounded to it leaves none out.
        good = np.flatnonzero(scores >= self.kth[at].astype(scores.dtype)[:, None])
        if not len(good):
            return
        i, j = np.divmod(good, len(ids))
        rows, found = at[i], ids[j]
        other = found != self.ids[rows]
        new = scores.ravel()[good[other]].astype(self.score.dtype)
        self.waiting.append((rows[other], found[other], new))
        if sum(len(w[0]) for w in self.waiting) > self.most_waiting:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        rows, found, new = (np.concatenate(w) for w in zip(*self.waiting, strict=True))
        self.waiting = []
        touched = np.zeros(len(self.ids), bool)
        touched[rows] = True
        kept = ~touched[self.at]
        a, f, s = top_rows(
            np.concatenate([self.at[~kept], rows]),
            np.concatenate([self.found[~kept], found]),
            np.concatenate([self.score[~kept], new]),
            self.k,
        )
        counts = np.bincount(a, minlength=len(self.ids))
        full = np.flatnonzero(counts == self.k)
        last = np.searchsorted(a, full, side="right") - 1
        self.kth[full] = np.maximum(self.kth[full], s[last])
        self.at = np.concatenate([self.at[kept], a])
        self.found = np.concatenate([self.found[kept], f])
        self.score = np.concatenate([self.score[kept], s])


def search_all(
    vectors: DataFrame,
    queries: Column,
    build: Callable[[np.ndarray, np.ndarray, int], object],
    search: Search,
    k: int,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
    kind: str = "double",
) -> DataFrame:
    """The k best vectors of each query among all others: query_id, rank, vec_id, score,
    a double or (``kind``) a long.

    Two waves: a block is searched in one shard first; the kth scores found there are
    the bounds that its queries bring to all other shards, and they rise from shard to
    shard of a tile, so a tile returns k rows of a query at most. The driver sees the
    numbers of shards and blocks.
    """
    spark = vectors.sparkSession
    shards = stored(in_shards(small_batches(vectors), build, shard_rows), "shards", **LARGE_ROWS)
    chosen = vectors.filter(queries)
    raw = lambda ids, matrix, _: (ids, narrowed(matrix))
    blocks = stored(
        in_shards(chosen.coalesce(_few(chosen)), raw, block_rows).withColumnRenamed(
            "shard", "block"
        ),
        "blocks",
        **LARGE_ROWS,
    )
    shards_of, blocks_of = _by_length(shards, "shard"), _by_length(blocks, "block")
    if not blocks_of:
        return best_of(spark.createDataFrame([], FOUND.format(kind=kind)), k)
    first: tuple[list, list] = [], []
    all_: tuple[list, list] = [], []
    homes, n_first, n_all = [], 0, 0
    for dim, asked in blocks_of.items():
        held = shards_of[dim]
        for i, block in enumerate(asked):
            homes.append((block, held[i % len(held)]))
            first[0].append((block, n_first + i, n_first + i, 1))
        for i, shard in enumerate(held[: len(asked)]):
            first[1].append((shard, n_first + i, n_first + len(asked) - 1, len(held)))
        n_first += len(asked)
        across = -(-len(asked) // TILE_BLOCKS)
        wanted = TILES_A_CORE * spark.sparkContext.defaultParallelism
        down = max(-(-len(held) // TILE_SHARDS), min(len(held), -(-wanted // across)))
        for i, block in enumerate(asked):
            at = n_all + i % across
            all_[0].append((block, at, at + (down - 1) * across, across))
        for i, shard in enumerate(held):
            at = n_all + i % down * across
            all_[1].append((shard, at, at + across - 1, 1))
        n_all += across * down
    nothing = {
        "home": F.lit(None).cast("long"), "known": F.array().cast("array<long>"),
        "bounds": F.array().cast(f"array<{kind}>"),
    }
    asked = blocks.select("block", "data")
    tiles = _in_tiles(asked.withColumns(nothing), first[0], shards, first[1])
    home = stored(search_tiles(tiles, min(n_first, MOST_PARTITIONS), search, k, kind), "first")
    bounds = (
        home.groupBy("block", "query_id")
        .agg(F.count("*").alias("n"), F.min("score").alias("bound"))
        .filter(F.col("n") == k)
        .groupBy("block")
        .agg(F.collect_list("query_id").alias("known"), F.collect_list("bound").alias("bounds"))
    )
    asked = (
        asked.join(F.broadcast(spark.createDataFrame(homes, "block long, home long")), "block")
        .join(bounds, "block", "left")
        .withColumns({c: F.coalesce(c, nothing[c]) for c in ("known", "bounds")})
    )
    tiles = _in_tiles(asked, all_[0], shards, all_[1])
    rest = search_tiles(tiles, min(n_all, MOST_PARTITIONS), search, k, kind)
    return best_of(home.unionByName(rest), k)


def _by_length(stored_rows: DataFrame, name: str) -> dict[int, list[int]]:
    """The numbers of the shards or blocks, by the length of their vectors."""
    out: dict[int, list[int]] = {}
    for number, dim in stored_rows.select(name, "dim").orderBy("dim", name).collect():
        out.setdefault(dim, []).append(number)
    return out


def _few(df: DataFrame) -> int:
    """Splits for the blocks of queries: fewer than those of the scan, so that a
    block holds queries of several."""
    return max(1, df.rdd.getNumPartitions() // 8)
