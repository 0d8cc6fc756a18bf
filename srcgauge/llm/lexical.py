"""Ranked lexical search with a document FP-tree.

Each document is reduced to its term vector restricted to the terms of the items, in
order of falling document frequency, and the documents of a run (a few thousand rows of
one input split) become a tree in which vectors that start alike share a path. A node
keeps, over its subtree, the largest term frequencies, the smallest length norm m and the
smallest id. A score rises with the term frequency and falls with m, so these give an
upper bound for every document below. Each item walks the tree depth first, dearest child
first, and leaves out a child whose bound can't enter the item's best ones any more; the
kth score found is carried over the runs of a task. All arithmetic is in 64-bit integers,
bounds included, so nothing is lost.

Chains without a branch are one edge, and a subtree of at most ``LEAF_DOCS`` documents is
scored at once.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcgauge.llm.common import slices, small_batches, stored, texts_of

#: Terms are runs of ASCII letters, digits and all characters beyond ASCII.
_TERM_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_LOWER = bytes(range(256)).lower()
SPLIT = bytes(_LOWER[b] if _LOWER[b] in _TERM_BYTES else 0x20 for b in range(256))
#: Bytes of a text whose terms are counted together.
WINDOW = 1 << 20
#: Terms, with repeats, of the items that are searched together, on average.
BLOCK_TERMS = 200_000
#: Documents of a tree, and of a subtree that is scored at once.
TREE_DOCS = 16_384
LEAF_DOCS = 16


def term_counts(text: str, table: bytes = SPLIT) -> Counter[bytes]:
    """Terms of a whole text with their counts, in windows that end between terms."""
    data = text.encode().translate(table)
    counts: Counter[bytes] = Counter()
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + WINDOW)
        stop = len(data) if stop < 0 else stop
        counts.update(data[start:stop].split())
        start = stop
    return counts


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term; terms by place in the vocabulary."""
    schema = "doc_id long, n long, terms array<int>, tfs array<int>"
    fields = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()),
        ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, terms, tfs = [], [], []
            for text in texts_of(batch, "text"):
                counts = term_counts(text)
                n.append(sum(counts.values()))
                kept = [(vocabulary[t], c) for t, c in counts.items() if t in vocabulary]
                terms.append([t for t, _ in kept])
                tfs.append([c for _, c in kept])
            arrays = [batch.column("doc_id").cast(pa.int64()), *map(pa.array, (n, terms, tfs), fields.types[1:])]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, schema).filter("n > 0")


def _items(items: DataFrame) -> DataFrame:
    """(item_id, terms, tfs) of the items with a term."""
    schema = "item_id long, terms array<binary>, tfs array<long>"
    fields = pa.schema([
        ("item_id", pa.int64()), ("terms", pa.list_(pa.binary())), ("tfs", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts = [term_counts(t) for t in texts_of(batch, "text")]
            arrays = [
                batch.column("item_id").cast(pa.int64()),
                pa.array([list(c) for c in counts], fields.types[1]),
                pa.array([list(c.values()) for c in counts], fields.types[2]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    found = small_batches(items.select("item_id", "text")).mapInArrow(run, schema)
    return found.filter("size(terms) > 0").withColumn("item", F.monotonically_increasing_id())


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of weight scores: rises with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """A compressed FP-tree over the restricted vectors of a run of documents.

    ``blocks[i]`` describes the children of a node: where each one's terms start, the
    terms, their weighted gains (bounds, or exact for a document), the smallest id key
    below, and the child (a node, or ~document).
    """

    def __init__(
        self, terms: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray, keys: np.ndarray, weights: np.ndarray
    ):
        paths = [t.astype(">u4").tobytes() for t in terms]
        order = sorted(range(len(paths)), key=lambda i: (paths[i], keys[i]))
        self.terms = [terms[i] for i in order]
        self.tfs = [tfs[i] for i in order]
        self.m, self.keys, self.weights = m[order], keys[order], weights
        self.order = order
        self.blocks: list[tuple[np.ndarray, ...]] = []
        self.root = self._grow(self._shared([paths[i] for i in order])) if order else None

    @staticmethod
    def _shared(paths: list[bytes]) -> list[int]:
        """Terms that neighbouring paths share."""
        out = []
        for a, b in zip(paths, paths[1:]):
            k = min(len(a), len(b))
            if a[:k] == b[:k]:
                out.append(k // 4)
                continue
            differs = np.frombuffer(a, np.uint8, k) != np.frombuffer(b, np.uint8, k)
            out.append(int(differs.argmax()) // 4)
        return out

    def _grow(self, shared: list[int]) -> int:
        """Nodes from the lengths that neighbours share; a node is finished when it is left."""
        open_: list[tuple[int, list]] = [(0, [])]  # (depth, children as (first, end, summary, block))
        for i, depth in enumerate([*shared, 0]):
            node = (i, i + 1, None, ~i)
            while open_[-1][0] > depth:
                children = open_.pop()[1]
                node = self._close([*children, node])
            if open_[-1][0] < depth:
                open_.append((depth, [node]))
            else:
                open_[-1][1].append(node)
        return self._block(open_[0][1])

    def _documents(self, first: int, end: int) -> list[tuple]:
        return [(i, i + 1, None, ~i) for i in range(first, end)]

    def _close(self, children: list[tuple]) -> tuple:
        first, end = children[0][0], children[-1][1]
        small = end - first <= LEAF_DOCS
        if small:  # nodes below are not kept: the documents are scored at once
            children = self._documents(first, end)
        summary = self._largest(children)
        return first, end, summary, None if small else self._block(children)

    def _summary(self, child: tuple) -> tuple[np.ndarray, np.ndarray]:
        return (self.terms[child[0]], self.tfs[child[0]]) if child[2] is None else child[2]

    def _largest(self, children: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Largest frequency of each term below."""
        parts = [self._summary(c) for c in children]
        terms = np.concatenate([p[0] for p in parts])
        tfs = np.concatenate([p[1] for p in parts])
        by_term = np.argsort(terms, kind="stable")
        terms, tfs = terms[by_term], tfs[by_term]
        at = np.flatnonzero(np.diff(terms, prepend=-1))
        return terms[at], np.maximum.reduceat(tfs, at)

    def _block(self, children: list[tuple]) -> int:
        parts = [self._summary(c) for c in children]
        sizes = np.array([len(p[0]) for p in parts])
        terms = np.concatenate([p[0] for p in parts])
        least_m = np.array([self.m[c[0] : c[1]].min() for c in children])
        values = self.weights[terms] * gain(np.concatenate([p[1] for p in parts]), np.repeat(least_m, sizes))
        least = np.array([self.keys[c[0] : c[1]].min() for c in children])
        below = []
        for first, end, _, block in children:
            if block is None:  # a small subtree gets its block of documents
                block = self._block(self._documents(first, end))
            below.append(block)
        self.blocks.append((np.cumsum(sizes) - sizes, terms, values, least, np.array(below)))
        return len(self.blocks) - 1

    def search(self, counts: np.ndarray, best: list[tuple], k: int, ids: list) -> int:
        """Put the documents that belong there into ``best``, a heap of the k best (score,
        -key, id is null, id); returns how many documents were scored."""
        scored = 0
        todo = [] if self.root is None else [(0, 0, self.root)]
        while todo:
            bound, key, at = todo.pop()
            if len(best) == k and bound and (bound, -key) <= best[0][:2]:
                continue
            starts, terms, values, least, below = self.blocks[at]
            bounds = np.add.reduceat(counts[terms] * values, starts)
            alive = bounds > 0
            scored += int(np.count_nonzero(below < 0))
            if len(best) == k:
                floor, last = best[0][0], np.uint64(-best[0][1])
                alive &= (bounds > floor) | ((bounds == floor) & (least < last))
            alive = np.flatnonzero(alive)
            alive = alive[np.lexsort((least[alive], -bounds[alive]))]
            inner = []
            for i in alive.tolist():
                entry = (int(bounds[i]), -int(least[i]))
                if below[i] >= 0:
                    inner.append((entry[0], int(least[i]), int(below[i])))
                    continue
                found = ids[self.order[~below[i]]]
                if len(best) < k:
                    heapq.heappush(best, (*entry, found is None, found))
                elif entry > best[0][:2]:
                    heapq.heapreplace(best, (*entry, found is None, found))
            todo.extend(reversed(inner))
        return scored


def _keys(ids: pa.Array) -> np.ndarray:
    """Ids as unsigned numbers in the same order; null comes last."""
    plain = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = plain.view(np.uint64) ^ np.uint64(1 << 63)
    keys[~ids.is_valid().to_numpy(zero_copy_only=False)] = np.uint64(2**64 - 1)
    return keys


def _search(docs: DataFrame, items: list, k: int) -> DataFrame:
    """The k best documents of each item among those of each task."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for r in items for t in map(bytes, r.terms)}))}
    vectors = stored(_vectors(docs, vocabulary), "lexical-vectors")
    n_docs, length = vectors.agg(F.count("*"), F.sum("n")).first()
    held = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    df = np.zeros(len(vocabulary), np.int64)
    df[[r["t"] for r in held]] = [r["count"] for r in held]
    by_frequency = np.argsort(-df, kind="stable")
    place = np.empty_like(by_frequency)
    place[by_frequency] = np.arange(len(df))
    weights = np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df[by_frequency].tolist()], np.int64
    )
    queries = [
        (r.item, r.item_id, place[[vocabulary[bytes(t)] for t in r.terms]], np.array(r.tfs, np.int64))
        for r in items
    ]
    schema = "item long, item_id long, doc_id long, score long, scored long"
    fields = pa.schema([(f, pa.int64()) for f in ("item", "item_id", "doc_id", "score", "scored")])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for batch in slices(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= TREE_DOCS:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held)

    def tree_of(run: pa.Table) -> tuple[Tree, list]:
        run = run.combine_chunks()
        lists, tfs = run["terms"].chunk(0), run["tfs"].chunk(0)
        cuts = lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py()
        terms = np.split(place[lists.flatten().to_numpy()], cuts)
        tfs = np.split(tfs.flatten().to_numpy().astype(np.int64), cuts)
        sorts = [np.argsort(t) for t in terms]
        m = np.array([25 + 75 * n * n_docs // length for n in run["n"].to_pylist()], np.int64)
        tree = Tree(
            [t[s] for t, s in zip(terms, sorts)], [t[s] for t, s in zip(tfs, sorts)],
            m, _keys(run["doc_id"].chunk(0)), weights,
        )
        return tree, run["doc_id"].to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in queries]
        scored = [0] * len(queries)
        counts = np.zeros(len(weights), np.int64)
        for docs in runs(batches):
            tree, ids = tree_of(docs)
            for q, (_, _, terms, tfs) in enumerate(queries):
                counts[terms] = tfs
                scored[q] += tree.search(counts, best[q], k, ids)
                counts[terms] = 0
        rows = [
            (item, item_id, doc, score, scored[q])
            for q, (item, item_id, _, _) in enumerate(queries) for score, _, _, doc in best[q]
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=fields)

    return vectors.filter("size(terms) > 0").mapInArrow(run, schema)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k documents that score highest for each item: item_id, rank, doc_id, score.

    ``docs``: (doc_id, text), ``items``: (item_id, text); other columns are ignored. Terms
    come from whole texts; a null or empty text has none. Every row of ``docs`` is a
    document and every row of ``items`` an item, also repeated ones; an item without a
    term, or whose terms are in no document, has no rows. Equal scores go by doc_id, a null
    id last. Empty tables give an empty result.

    Items are searched in blocks of some ``BLOCK_TERMS`` terms, so what tasks are sent is
    bounded; each block reads the documents once. Tasks keep k documents an item, which
    are merged by item.
    """
    found = stored(_items(items), "lexical-items")
    terms = found.agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    blocks = max(1, -(-terms // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    parts = []
    for b in range(blocks):
        rows = found.filter(block == b).collect()
        if rows:
            parts.append(_search(docs, rows, k))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
