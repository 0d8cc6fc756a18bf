"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

Signature: each element of a set draws, level by level, a random value and a slot of
a random permutation of the slots; a slot keeps its smallest level + value. Levels
end for a set as soon as every slot holds a value of a finished level, since later
ones are larger, which is after about one level for long texts.

Groups, without comparing all pairs of anything:

1. Texts with equal shingle sets are one class; only its smallest id goes on.
2. Bands of signatures bring representatives into buckets. Each is compared with
   its bucket's smallest id, on full sets; links are joined into components.
3. Members of one bucket that are still in different components are compared with
   one another inside tasks: families of buckets that share members are dealt into
   blocks, and a task compares two blocks. Only links leave it. So every pair that
   shares a bucket is either linked through others or compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgauge.llm.common import mixed, slices, small_batches, stored, texts_of

SLOTS = 128
BANDS = 32
#: Nodes that a task's union-find holds before it gives out its stars.
FOREST_NODES = 500_000
#: Members of a block of step 3.
BLOCK = 512
#: Bits kept of each slot, and slots that must agree in them for a pair to be
#: compared in step 3. A pair of similarity 0.8 agrees in 104 of 128 on average with a
#: standard deviation of at most 4.4.
KEPT_BITS = 4
AGREEING = 83
STEP_BYTES = 1 << 20

_rng = np.random.default_rng(2017)
#: A number per byte, with A-Z as a-z.
LETTERS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
LETTERS[65:91] = LETTERS[97:123]
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
GOLDEN = np.uint64(0xD1B54A32D192ED03)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_known_powers = _powers(1)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word of the texts, in order."""
    global _known_powers
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    if len(data) + 1 > len(_known_powers[0]):
        _known_powers = _powers(max(2 * STEP_BYTES, len(data) + 1))
    power, inverse = _known_powers
    space = SPACES[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * power[: len(data)], out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * inverse[start])
    ends = np.cumsum([len(r) + 1 for r in raw]) + 1
    return np.searchsorted(ends, start, side="right"), hashes


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, shingle hash), ordered by both.

    A text of fewer words than ``size`` has its whole sequence as one shingle.
    """
    text, word = words(texts)
    count = np.bincount(text, minlength=len(texts))
    n = max(0, len(word) - size + 1)
    joined = word[:n].copy()
    for i in range(1, size):
        joined = joined * BASE + word[i : i + n]
    inside = text[:n] == text[size - 1 :][:n]
    owner, joined = text[:n][inside], joined[inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.cumsum(count) - count
        whole = []
        for t in short.tolist():
            h = word[first[t]]
            for w in word[first[t] + 1 : first[t] + count[t]]:
                h = h * BASE + w
            whole.append(h + np.uint64(count[t]) * GOLDEN)
        owner = np.concatenate([owner, short])
        joined = np.concatenate([joined, np.array(whole, np.uint64)])
    joined = mixed(joined)
    order = np.lexsort((joined, owner))
    owner, joined = owner[order], joined[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (joined[1:] != joined[:-1])
    return owner[new], joined[new]


def signatures(owner: np.ndarray, element: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signature of each text's set: uint64 (texts, slots).

    The upper half of a value is its level. A text without elements keeps the
    largest number everywhere.
    """
    with np.errstate(over="ignore"):
        best = np.full((texts, slots), np.iinfo(np.uint64).max, np.uint64)
        flat = best.ravel()
        swaps: list[np.ndarray] = []
        for level in range(slots):
            if not len(owner):
                break
            draw = mixed(element + np.uint64(level + 1) * GOLDEN)
            value = np.uint64(level << 32) | (draw >> np.uint64(32))
            span = np.uint64(slots - level)
            other = level + ((draw & np.uint64(0xFFFFFFFF)) * span >> np.uint64(32)).astype(np.int64)
            slot = other
            for earlier in range(level - 1, -1, -1):  # undo the swaps: whose place it was
                slot = np.where(slot == swaps[earlier], earlier, slot)
            np.minimum.at(flat, owner * slots + slot, value)
            swaps.append(other)
            open_ = best.max(axis=1) >= np.uint64((level + 1) << 32)
            more = open_[owner]
            if not more.all():
                owner, element = owner[more], element[more]
                swaps = [s[more] for s in swaps]
    return best


SKETCH = "doc_id long, n long, h1 long, h2 long, bands array<long>, kept binary"


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP_BYTES):
            n = batch.num_rows
            with np.errstate(over="ignore"):
                owner, element = shingles(texts_of(batch, "text"), size)
                count = np.bincount(owner, minlength=n)
                some = np.flatnonzero(count)
                sums = np.zeros((2, n), np.uint64)
                if len(some):
                    first = (np.cumsum(count) - count)[some]
                    sums[0, some] = np.add.reduceat(mixed(element), first)
                    sums[1, some] = np.add.reduceat(mixed(element ^ GOLDEN), first)
                best = signatures(owner, element, n)
                rows = SLOTS // BANDS
                keys = np.zeros((n, BANDS), np.uint64)
                for i in range(rows):
                    keys = mixed(keys * BASE + best[:, i::rows][:, :BANDS])
                keys = mixed(keys + np.arange(BANDS, dtype=np.uint64) * GOLDEN)
                few = (mixed(best) & np.uint64((1 << KEPT_BITS) - 1)).astype(np.uint8)
            kept = few[:, ::2] << KEPT_BITS | few[:, 1::2]
            ends = np.arange(n + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n": count.astype(np.int64),
                    "h1": sums[0].view(np.int64),
                    "h2": sums[1].view(np.int64),
                    "bands": pa.ListArray.from_arrays(ends, keys.ravel().view(np.int64)),
                    "kept": pa.array([row.tobytes() for row in kept], pa.binary()),
                }
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP_BYTES):
            with np.errstate(over="ignore"):
                owner, element = shingles(texts_of(batch, "text"), size)
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "elements": pa.ListArray.from_arrays(ends, element.view(np.int64)),
                }
            )

    return run


def _join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose two sides meet in the tasks, never a broadcast.

    Whether a table is broadcast follows the size of its files, in which ids are packed: its
    hash table takes several times that in the driver, and a loop leaves many of them there.
    """
    return left.join(right.hint("merge"), on, how)


def _open(pairs: DataFrame) -> bool:
    """Whether (a, b) links are more than stars: a node is a centre and a leaf, or a leaf twice."""
    ends = F.explode(
        F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("leaf")),
                F.struct(F.col("b").alias("node"), F.lit(1).alias("leaf")))
    )
    nodes = pairs.select(ends.alias("end")).groupBy("end.node")
    return not (
        nodes.agg(F.sum("end.leaf").alias("leaf"), F.min("end.leaf").alias("least"))
        .filter("leaf > 1 or (leaf = 1 and least = 0)")
        .isEmpty()
    )


def components(links: DataFrame, purpose: str) -> DataFrame:
    """Connected components of (a, b) links: one row per node, its smallest reachable node.

    Each split joins its own links by union-find first, which leaves a forest of
    stars. Then large-star and small-star steps alternate until only stars are left;
    each is an aggregation and a join by node, and its result is written, so no
    component has to fit into a task.
    """

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        def stars() -> pa.RecordBatch:
            rows = [(root(x), x) for x in list(parent)]
            parent.clear()
            rows = np.array([r for r in rows if r[0] != r[1]], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_pydict({"a": rows[:, 0], "b": rows[:, 1]})

        for batch in batches:
            for a, b in zip(
                batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True
            ):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > FOREST_NODES:
                yield stars()
        yield stars()

    pairs = stored(links.select("a", "b").mapInArrow(forest, "a long, b long"), purpose)
    while _open(pairs):
        # Large star: larger neighbours of a node go to the smallest around it.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = _join(both.filter("b > a"), least, "a").select(F.col("m").alias("a"), "b")
        large = large.distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = _join(large, least, "b").select(
            F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")
        )
        pairs = stored(
            small.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(),
            purpose,
        )
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        _join(_join(pairs, right, "b"), left, "a")
        .filter(100 * both >= percent * (F.size("x") + F.size("y") - both))
        .select("a", "b")
    )


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    links = stored(links, "links")
    if links.isEmpty():
        return found
    stars = found.select(F.col("root").alias("a"), F.col("node").alias("b"))
    return components(stars.unionByName(links), "components")


def _unresolved(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members, with their component, of buckets that hold several components."""
    roots = found.select(F.col("node").alias("doc_id"), "root")
    now = _join(members.drop("root"), roots, "doc_id", "left")
    now = now.withColumn("root", F.coalesce("root", "doc_id"))
    several = (
        now.groupBy("key")
        .agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
        .filter("r1 < r2")
        .select("key")
    )
    return stored(_join(now, several, "key", "left_semi"), "unresolved")


def _compare(percent: int):
    """Links between the members of two blocks of a family, or inside one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        ids, root = pdf["doc_id"].to_numpy(), pdf["root"].to_numpy()
        size = np.array([len(e) for e in pdf["elements"]])
        block, one = pdf["block"].to_numpy(), pdf["i"].iloc[0] == pdf["j"].iloc[0]
        bands = np.array(pdf["bands"].tolist(), np.int64)
        packed = np.frombuffer(b"".join(pdf["kept"]), np.uint8).reshape(len(pdf), -1)
        kept = np.concatenate([packed >> KEPT_BITS, packed & ((1 << KEPT_BITS) - 1)], axis=1)
        _, element = np.unique(np.concatenate(pdf["elements"].to_list()), return_inverse=True)
        ends = np.cumsum(size)
        marked = np.zeros(element.max() + 1, bool)
        links = []
        for x in range(len(pdf)):
            y = np.arange(x + 1, len(pdf))
            y = y[root[y] != root[x]] if one else y[(root[y] != root[x]) & (block[y] != block[x])]
            least, most = np.minimum(size[y], size[x]), np.maximum(size[y], size[x])
            y = y[100 * least >= percent * most]
            y = y[(bands[y] == bands[x]).any(axis=1)]
            y = y[(kept[y] == kept[x]).sum(axis=1) >= AGREEING]
            if not len(y):
                continue
            marked[element[ends[x] - size[x] : ends[x]]] = True
            parts = [marked[element[ends[z] - size[z] : ends[z]]] for z in y]
            both = np.add.reduceat(
                np.concatenate(parts).astype(np.int64), np.cumsum(size[y]) - size[y]
            )
            marked[element[ends[x] - size[x] : ends[x]]] = False
            good = 100 * both >= percent * (size[x] + size[y] - both)
            links += [(ids[x], ids[z]) for z in y[good]]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _across(open_: DataFrame, sketch: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket in different components.

    In a family only members outside its largest component are compared with all:
    they are dealt into blocks, those of the largest component into others, and a
    member goes to each pair of blocks that it is needed in.
    """
    stars = open_.filter("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()
    family = components(stars, "families")
    docs = open_.select("doc_id", "root").distinct()
    docs = stored(
        _join(
            docs,
            family.select(F.col("node").alias("doc_id"), F.col("root").alias("family")),
            "doc_id",
            "left",
        ).withColumn("family", F.coalesce("family", "doc_id")),
        "families",
    )
    sizes = docs.groupBy("family", "root").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("family").agg(
        F.max(F.struct("n", F.col("root").alias("major"))).alias("m"), F.sum("n").alias("all")
    )
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select(
        "family", "m.major", blocks(F.col("all") - F.col("m.n")).alias("rest"),
        blocks(F.col("m.n")).alias("major_blocks"),
    )
    sizes = stored(sizes, "families")  # so that the join of a large family can be split
    draw = F.xxhash64("doc_id")
    own = F.when(
        F.col("root") == F.col("major"), F.col("rest") + F.pmod(draw, F.col("major_blocks"))
    ).otherwise(F.pmod(draw, F.col("rest")))
    pair = lambda t: F.struct(
        F.least("block", t).alias("i"), F.greatest("block", t).alias("j")
    )
    to = F.when(F.col("block") >= F.col("rest"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("rest") + F.col("major_blocks") - 1)
    )
    dealt = (
        _join(docs, sizes, "family")
        .withColumn("block", own.cast("int"))
        .select("doc_id", "root", "family", "block", F.transform(to, pair).alias("pairs"))
    )
    full = (
        _join(_join(dealt, sketch.select("doc_id", "bands", "kept"), "doc_id"), sets, "doc_id")
        .select("*", F.inline("pairs"))
        .drop("pairs")
    )
    return full.groupBy("family", "i", "j").applyInPandas(_compare(percent), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    words_per_shingle: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups of documents linked by similar shingle sets.

    Words are runs of other than space and 0x09-0x0D, with A-Z lower-cased; a set
    holds the distinct shingles of ``words_per_shingle`` words, or the whole sequence
    if there are fewer. Two documents are linked if 100 * intersection >=
    ``percent`` * union. Result, one row per input row: doc_id, n_shingles,
    component_id (the smallest id reachable), kept (doc_id = component_id).

    A text that is null or without words has an empty set and is linked with
    nothing. Rows that repeat an id and text are one node, and get the same result;
    rows of one id with different texts each get the component of their text. A
    row with a null id is linked with nothing, has a null component and is kept.
    An empty table gives no rows; other columns are ignored.

    Candidates are found by 32 bands of 4 slots: a pair of similarity 0.8 shares none
    with probability 5e-8.
    """
    docs = small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = stored(rows.mapInArrow(_sketch(words_per_shingle), SKETCH), "sketches")
    sets_of = ["n", "h1", "h2"]
    real = sketch.filter("n > 0 and doc_id is not null")
    classes = stored(
        real.groupBy(sets_of).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")),
        "classes",
    )
    firsts = classes.select(F.col("first").alias("doc_id"), *sets_of)
    marked = _join(real, firsts, ["doc_id", *sets_of], "left_semi")

    banded = stored(
        marked.select("doc_id", F.explode("bands").alias("key")), "bands"
    )
    shared = stored(
        banded.groupBy("key")
        .agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("members"))
        .filter("a < z"),
        "buckets",
    )
    members = stored(
        _join(banded, shared.drop("z"), "key").select("key", "a", "members", "doc_id"),
        "members",
    )
    pairs = stored(
        members.filter("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct(), "pairs"
    )
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(
        members.filter("members > 2").select("doc_id")
    )
    texts = _join(rows, wanted.distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = stored(
        texts.mapInArrow(_sets(words_per_shingle), "doc_id long, elements array<long>"), "sets"
    )
    found = components(_verified(pairs, sets, percent), "components")
    open_ = _unresolved(members.filter("members > 2"), found)
    found = _joined(found, _across(open_, marked, sets, percent))

    digests = sketch.select("doc_id", *sets_of)
    copies = classes.filter("copies > 1").select("first", *sets_of)
    with_class = _join(digests, copies, sets_of, "left").withColumn(
        "first", F.coalesce("first", "doc_id")
    )
    with_root = _join(with_class, found.withColumnsRenamed({"node": "first"}), "first", "left")
    component = F.coalesce("root", F.when(F.col("n") > 0, F.col("first")), "doc_id")
    return with_root.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
