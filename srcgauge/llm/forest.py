"""Approximate nearest neighbours: forests of random-projection trees.

Each shard has a forest. A tree halves its rows at the median of a random
projection (the direction between two random rows). A query descends all trees
through one shared priority queue: a branch's priority is the smallest margin on
its path, and branches of every tree are taken by priority. Every split is a
median, so a tree is a full array of levels and the priorities of all its leaves
are computed for a whole block of queries at once; the leaves that the queue would
open first are those of highest priority. Candidates of these leaves are reranked
by the exact measure.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgauge.llm.shards import Best, finite, search_all

TREES = 16
LEAF_ROWS = 64
#: Leaves opened per query, as a share of the leaves of a shard's forest.
OPENED = 0.12


@dataclass
class Forest:
    ids: np.ndarray
    rows: np.ndarray
    #: Per tree and level: directions and offsets of the splits.
    trees: list[list[tuple[np.ndarray, np.ndarray]]]
    #: Row numbers of each leaf, tree by tree.
    leaves: list[np.ndarray]


def build(ids: np.ndarray, matrix: np.ndarray, shard: int) -> Forest:
    rng = np.random.default_rng([17, shard])
    levels = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF_ROWS))))
    trees, leaves = [], []
    for _ in range(TREES):
        groups, tree = [np.arange(len(ids))], []
        for _ in range(levels):
            directions, offsets, halves = [], [], []
            for group in groups:
                one, other = matrix[rng.choice(group, 2, replace=False)]
                direction = one - other
                if not direction.any():  # repeated rows: any direction will do
                    direction = rng.standard_normal(len(one))
                direction = direction / np.sqrt((direction**2).sum())
                along = matrix[group] @ direction
                half = len(group) // 2
                order = np.argpartition(along, half)
                directions.append(direction)
                offsets.append(along[order[half]])
                halves += [group[order[:half]], group[order[half:]]]
            tree.append((np.array(directions), np.array(offsets)))
            groups = halves
        trees.append(tree)
        leaves += groups
    return Forest(ids, matrix, trees, leaves)


def priorities(forest: Forest, queries: np.ndarray) -> np.ndarray:
    """The priority with which each leaf of the forest leaves the shared queue."""
    out = []
    for tree in forest.trees:
        p = np.full((len(queries), 1), np.inf)
        for directions, offsets in tree:
            margin = queries @ directions.T - offsets
            p = np.stack([np.minimum(p, -margin), np.minimum(p, margin)], axis=2)
            p = p.reshape(len(queries), -1)
        out.append(p)
    return np.concatenate(out, axis=1)


def search(
    forest: Forest, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int,
    best: Best | None = None,
):
    best = best or Best(ids, bound, k)
    leaves = len(forest.leaves)
    # Shards of few leaves: at least as many as three of each tree.
    least = 3 * TREES
    opened = min(leaves, max(least, int(np.ceil(OPENED * leaves))))
    step = max(1, (1 << 23) // leaves)
    for low in range(0, len(ids), step):
        some = np.arange(low, min(len(ids), low + step))
        first = np.argpartition(-priorities(forest, queries[some]), opened - 1, axis=1)
        leaf = first[:, :opened].ravel()
        query = np.repeat(some, opened)
        order = np.argsort(leaf, kind="stable")
        leaf, query = leaf[order], query[order]
        edges = np.searchsorted(leaf, np.arange(leaves + 1))
        for number in np.flatnonzero(np.diff(edges)).tolist():
            at = query[edges[number] : edges[number + 1]]
            rows = forest.leaves[number]
            best.offer(at, forest.ids[rows], queries[at] @ forest.rows[rows].T)
    best.settle()
    return best.at, best.found, best.score


def nearest(
    df: DataFrame,
    k: int = 20,
    query_every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k nearest vectors found for each query, by largest inner product.

    Queries are the rows whose id is divisible by ``query_every``; candidates all
    other rows. Result: query_id, rank from 1, vec_id, score (the inner product of
    the original vectors in double precision); ties go to the smaller vec_id.
    Vectors that are null, empty or zero or hold null or non-finite components, and
    rows with a null id, take no part; vectors of another length than the query's
    are no candidates. Equal (id, score) results appear once. Other columns are
    ignored; an empty table gives no rows. Every row is indexed: a shard's trees
    are built on all its rows. The share of leaves opened is the same in every
    shard, so recall does not depend on the size of the table.
    """
    vector = F.col(vector_col).cast("array<double>")
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    vectors = vectors.filter(
        F.col("vec_id").isNotNull() & finite("vector") & F.exists("vector", lambda x: x != 0)
    )
    return search_all(vectors, F.col("vec_id") % query_every == 0, build, search, k)
