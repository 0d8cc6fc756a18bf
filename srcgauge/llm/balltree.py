"""Exact top-k by integer inner product: ball trees with branch and bound.

Each shard has a ball tree. Nodes are taken by the highest upper bound
``q . centre + |q| * radius`` of any query that still needs them; a query leaves a
node whose bound is below its current kth score. That score is shared over the
nodes of a shard and, from a first shard, with all other shards.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgauge.llm.shards import Best, finite, narrowed, search_all

LEAF_ROWS = 256
#: Products of whole numbers stay exact in single and in double precision below these.
EXACT_SINGLE = float(1 << 24)
EXACT = float(1 << 53)


@dataclass
class BallTree:
    ids: np.ndarray
    rows: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    #: Per node: first row, row after the last, left child (-1: a leaf); the right
    #: child follows the left one.
    spans: np.ndarray


def build(ids: np.ndarray, matrix: np.ndarray, _: int) -> BallTree:
    """Split at the median of the widest direction between two far rows."""
    order = np.arange(len(ids))
    spans, centres, radii = [[0, len(ids), -1]], [], []
    node = 0
    while node < len(spans):
        low, high, _ = spans[node]
        rows = matrix[order[low:high]]
        centre = rows.mean(axis=0)
        far = ((rows - centre) ** 2).sum(axis=1)
        centres.append(centre)
        radii.append(float(np.sqrt(far.max())))
        if high - low > LEAF_ROWS and radii[-1] > 0:
            one = rows[far.argmax()]
            other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            half = (high - low) // 2
            split = np.argpartition(rows @ (other - one), half)
            order[low:high] = order[low:high][split]
            spans[node][2] = len(spans)
            spans += [[low, low + half, -1], [low + half, high, -1]]
        node += 1
    return BallTree(
        ids[order], narrowed(matrix[order]), np.array(centres), np.array(radii), np.array(spans)
    )


def _exact_type(left: np.ndarray, right: np.ndarray) -> type:
    """The type in which inner products of whole numbers are exact: floating point where it
    is, else 64-bit integers, whose sums are right whenever the product fits."""
    top = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    return np.float32 if top < EXACT_SINGLE else np.float64 if top < EXACT else np.int64


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left @ right.T


def search(
    tree: BallTree, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int,
    best: Best | None = None,
):
    best = best or Best(ids, bound, k)
    rows = tree.rows.astype(np.float64)
    exact = _exact_type(queries, rows)
    whole, rows = queries.astype(exact), rows.astype(exact)
    norms = np.sqrt((queries**2).sum(axis=1))
    # Rounding may not cut a node: widen its bound a little.
    reach = queries @ tree.centres.T + np.outer(norms, tree.radii)
    reach += 1e-9 * (1 + np.abs(reach))
    everyone = np.arange(len(ids))
    heap = [(-float(reach[:, 0].max(initial=0)), 0, everyone)]
    while heap:
        _, node, active = heapq.heappop(heap)
        active = active[reach[active, node] >= best.kth[active]]
        if not len(active):
            continue
        low, high, child = tree.spans[node]
        if child < 0:
            for a in range(low, high, LEAF_ROWS):
                b = min(high, a + LEAF_ROWS)
                best.offer(active, tree.ids[a:b], _products(whole[active], rows[a:b]))
            continue
        for c in (child, child + 1):
            heapq.heappush(heap, (-float(reach[active, c].max()), int(c), active))
    best.settle()
    return best.at, best.found, best.score


def exact_top_k(
    df: DataFrame,
    k: int = 20,
    query_every: int = 20,
    scale: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k vectors of highest integer inner product for each query vector.

    Components are floor(scale * x) in double precision. Queries are the rows whose
    id is divisible by ``query_every``; candidates all other rows. Result: query_id,
    rank from 1, vec_id, score; ties go to the smaller vec_id; all candidates if
    there are fewer than k. Vectors that are null or empty or hold null or
    non-finite components, and rows with a null id, take no part; vectors of
    another length than the query's are no candidates. Rows that repeat an id are
    candidates each, but equal (id, score) results appear once. Other columns are
    ignored; an empty table gives no rows. Scores are whole numbers throughout, exact
    as long as they fit 64 bits.
    """
    vector = F.col(vector_col).cast("array<double>")
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"))
    vectors = vectors.filter(F.col("vec_id").isNotNull() & finite("v")).select(
        "vec_id",
        F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("vector"),
    )
    asked = F.col("vec_id") % query_every == 0
    return search_all(vectors, asked, build, search, k, kind="long")
