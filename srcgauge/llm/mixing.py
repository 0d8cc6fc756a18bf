"""Mixing sources to target weights.

The words of a source form one stream, in an order fixed by a hash of its rows, that is
packed into blocks of a fixed length. The mix is a table of output shards with so many
slots each. How many slots of a shard each source fills is drawn: multinomial counts
given that every source's counts add up to its target over all shards. (Independent
multinomials would miss the targets by their noise; given the totals, the joint law is a
multivariate hypergeometric one, which is drawn down a binary tree over the shards.) The
g-th slot of a source holds the block at place ``g mod blocks`` of a pseudorandom
permutation of the source's blocks, a new one for each pass over them. Blocks and slots
are joined by (source, block).

No process holds the counts of all shards or the list of all sources: a task draws its
own shards, sources travel as rows of groups of 1,024, and the driver sees one number a
group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgauge.llm.common import mixed, numbered, stored, with_columns
from srcgauge.llm.sharding import _draw

#: White space of the contract, for a character class.
WHITE = r"\x20\x09-\x0D"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's size.
MOST_PASSES = 3
#: Words of a block, and slots of an output shard.
BLOCK_WORDS = 512
SHARD_SLOTS = 1024
#: Sources that are drawn together, and parts into which the output shards are dealt.
GROUP_SOURCES = 1024
PARTS = 4096
#: Rows of a bucket, whose order one task fixes, and bits of the buckets that are added up together.
BUCKET_ROWS = 512
COARSE_BITS = 12
ROUNDS = 4


def word_count(text: str) -> Column:
    """Words of a text, counted without making them; null has none."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"^[{WHITE}]+", "")
    return F.length(F.regexp_replace(body, f"[^{WHITE}]+[{WHITE}]*", "x")).cast("long")


def _keys(seed: int, source: int, turn: int) -> np.ndarray:
    words = np.array([seed, source, turn], np.uint64)
    start = mixed(words * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, 4, dtype=np.uint64))
    base = mixed(np.array([start[0] ^ (start[1] << np.uint64(1)) ^ (start[2] << np.uint64(2))]))
    return mixed(base + np.arange(ROUNDS, dtype=np.uint64))


def permuted(
    at: np.ndarray, n: int, seed: int, source: int, turn: int, back: bool = False
) -> np.ndarray:
    """Where a pseudorandom permutation of 0 to n - 1 puts ``at`` (``back``: its inverse).

    A Feistel network over the next even number of bits; places past n walk on.
    """
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = _keys(seed, source, turn)
    out = at.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for key in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mixed(left + key) & low), left
            else:
                left, right = right, left ^ (mixed(right + key) & low)
        out[todo] = left << half | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def slots_of(size: int, words: int, block: int, seed: int, source: int) -> tuple[int, int, int]:
    """(blocks, slots, words of the last slot) that give ``words`` words of a source.

    Only its last block is shorter; where the passes before meet it is known from the
    permutation, so the last slot is cut to give the target to the word.
    """
    if size == 0 or words == 0:
        return -(-size // block), 0, 0
    blocks = -(-size // block)
    passes, rest = divmod(words, size)
    short = block - (size - block * (blocks - 1))  # words that the last block lacks
    if rest == 0:
        last = permuted(np.array([blocks - 1]), blocks, seed, source, passes - 1)[0]
        return blocks, passes * blocks, block - (short if last == blocks - 1 else 0)
    place = permuted(np.array([blocks - 1]), blocks, seed, source, passes, back=True)[0]
    slots = -(-rest // block)
    if place < slots and block * slots - short < rest:
        slots += 1
    before = block * (slots - 1) - (short if place < slots - 1 else 0)
    return blocks, passes * blocks + slots, rest - before


def shard_start(shard: int, slots: int, shards: int) -> int:
    """First slot of a shard; shard sizes differ by one at most."""
    return shard * (slots // shards) + min(shard, slots % shards)


def shard_counts(
    shard: int, shards: int, groups: np.ndarray, group: int, quotas: np.ndarray, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of a shard by group, by source of one group, and those sources' slots before it.

    All tasks that pass a node of the tree draw the same numbers for it.
    """
    slots = int(groups.sum())
    low, high, tops, mine = 0, shards, groups.copy(), quotas.copy()
    before = np.zeros_like(mine)
    while high - low > 1:
        mid = (low + high) // 2
        n = shard_start(mid, slots, shards) - shard_start(low, slots, shards)
        top = _draw(np.random.default_rng([seed, 1, low, high]), tops, n)
        left = _draw(np.random.default_rng([seed, 2, low, high, group]), mine, int(top[group]))
        if shard < mid:
            high, tops, mine = mid, top, left
        else:
            low, tops, mine, before = mid, tops - top, mine - left, before + left
    return tops, mine, before


def _targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Add ``target``: shares of all sizes by weight, stopped at ``most`` times a size.

    A stopped source's excess goes to the others by weight: the level, words a unit of
    weight, rises until no further source stops. Each round adds up the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("_weight", weight).withColumn("_most", most * F.col("source_size"))
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        ends = F.col("_most") <= F.lit(level) * F.col("_weight")
        count, filled, free = sources.agg(
            F.count_if(ends), F.sum(F.when(ends, F.col("_most"))), F.sum(F.when(~ends, F.col("_weight")))
        ).first()
        if count == stopped or not free:
            break
        level, stopped = (whole - (filled or 0)) / free, count
    target = F.least(F.col("_most").cast("double"), F.lit(level) * F.col("_weight"))
    return sources.withColumn("target", target).drop("_weight", "_most")


def mix(
    df: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, seed: int = 12,
    block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
) -> tuple[DataFrame, DataFrame]:
    """The mix of ``df`` (doc_id, text, source): its documents and its spans.

    Documents: doc_id, source, size (words), source_size, target, sid (the source's
    place), start (the row's first word in its source's stream). Spans, one for each
    part of a document in a slot: shard, slot (gapless from 0 in a shard), pass, block,
    offset (first word in the slot), sid, start, doc_id, first (word of the document),
    words. A source gives its target to the nearest word; no part of a document comes more
    than ``most`` times.

    Rows count one by one, also repeated ones; a null text has no words, a null source is
    a source of its own, the last. Rows without words are in no span. An empty table, or
    one without words, has targets of 0 and no spans. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_name"),
        F.col("source").isNull().alias("_none"), word_count("text").alias("size"),
        F.xxhash64("doc_id", "text").bitwiseAND((1 << 63) - 1).alias("_h"),
    )
    rows = stored(rows, "mix-rows")
    bits = max(0, (max(1, rows.count() // BUCKET_ROWS) - 1).bit_length())
    rows = rows.withColumn("_bucket", F.shiftright("_h", 63 - bits))

    sums = rows.groupBy("_none", "_name", "_bucket").agg(F.sum("size").alias("_sum"))
    fine = stored(sums.withColumn("_coarse", F.shiftright("_bucket", COARSE_BITS)), "mix-buckets")
    coarse = fine.groupBy("_none", "_name", "_coarse").agg(F.sum("_sum").alias("_all"))
    sizes = coarse.groupBy("_none", "_name").agg(F.sum("_all").alias("source_size"))
    sources = stored(_targets(numbered(sizes, "sid", "_none", "_name"), weights, most), "mix-sources")

    before = (Window.unboundedPreceding, -1)
    source = Window.partitionBy("_none", "_name")
    coarse = coarse.select(
        "_none", "_name", "_coarse",
        F.coalesce(F.sum("_all").over(source.orderBy("_coarse").rowsBetween(*before)), F.lit(0)).alias("_far"),
    )
    near = Window.partitionBy("_none", "_name", "_coarse").orderBy("_bucket").rowsBetween(*before)
    fine = (
        fine.join(coarse, ["_none", "_name", "_coarse"])
        .join(sources, ["_none", "_name"])
        .withColumn("_first", F.col("_far") + F.coalesce(F.sum("_sum").over(near), F.lit(0)))
        .select("_none", "_name", "_bucket", "_first", "sid", "source_size", "target")
    )
    bucket = Window.partitionBy("_none", "_name", "_bucket")
    order = bucket.orderBy("_h", "doc_id", "size").rowsBetween(*before)
    placed = rows.join(fine, ["_none", "_name", "_bucket"]).select(
        "doc_id", F.when(~F.col("_none"), F.col("_name")).alias("source"), "size", "source_size",
        "target", "sid", (F.col("_first") + F.coalesce(F.sum("size").over(order), F.lit(0))).alias("start"),
    )
    documents = stored(placed, "mix-documents")
    slots = _slots(sources, block_words, shard_slots, seed)

    stop = F.col("start") + F.col("size")
    cut = lambda at: (at / block_words).cast("long")  # noqa: E731  (exact: far below 2^53)
    pieces = (
        documents.filter("size > 0")
        .select("doc_id", "sid", "start", "size",
                F.explode(F.sequence(cut(F.col("start")), cut(stop - 1))).alias("block"))
        .withColumn("_from", F.greatest("start", F.col("block") * block_words))
        .withColumn("_to", F.least(stop, (F.col("block") + 1) * block_words))
        .select("doc_id", "sid", "start", "block",
                (F.col("_from") - F.col("block") * block_words).alias("offset"),
                (F.col("_from") - F.col("start")).alias("first"),
                (F.col("_to") - F.col("_from")).alias("_length"))
    )
    spans = (
        pieces.join(slots.hint("merge"), ["sid", "block"])  # grows with the mix: never broadcast
        .withColumn("words", F.least("_length", F.col("_words") - F.col("offset")))
        .filter("words > 0")
        .select("shard", "slot", "pass", "block", "offset", "sid", "start", "doc_id", "first", "words")
    )
    return documents, spans


def _slots(sources: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """The slots of all shards: shard, slot, sid, pass, block, _words."""
    more = "blocks long, slots long, last long"

    def quotas(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [
                slots_of(int(s), int(np.floor(t + 0.5)), block, seed, int(i))
                for i, s, t in zip(pdf["sid"], pdf["source_size"], pdf["target"])
            ]
            found = np.array(found, np.int64).reshape(-1, 3)
            yield pdf.assign(blocks=found[:, 0], slots=found[:, 1], last=found[:, 2])

    kept = sources.select("sid", "source_size", "target")
    kept = kept.mapInPandas(quotas, with_columns(kept.schema, more)).filter("slots > 0")
    fields = ("sid", "blocks", "slots", "last")
    grouped = kept.groupBy((F.col("sid") / GROUP_SOURCES).cast("long").alias("gid")).agg(
        F.sum("slots").alias("all"), F.sort_array(F.collect_list(F.struct(*fields))).alias("of")
    )
    grouped = stored(grouped, "mix-groups")
    tops = sorted(tuple(r) for r in grouped.select("gid", "all").collect())
    places = {gid: i for i, (gid, _) in enumerate(tops)}
    totals = np.array([n for _, n in tops], np.int64)
    shards = max(1, -(-int(totals.sum()) // shard_slots))
    parts = min(shards, PARTS)

    def drawn(shard: int, gid: int, of: dict[str, np.ndarray]) -> pd.DataFrame:
        group = places[gid]
        counts, mine, before = shard_counts(shard, shards, totals, group, of["slots"], seed)
        where = np.random.default_rng([seed, 3, shard]).permutation(int(counts.sum()))
        first = int(counts[:group].sum())
        of_slot = np.repeat(np.arange(len(mine)), mine)
        turn = np.arange(len(of_slot)) - np.repeat(np.cumsum(mine) - mine, mine) + before[of_slot]
        passes, at = np.divmod(turn, of["blocks"][of_slot])
        blocks = np.empty_like(at)
        cuts = np.flatnonzero(np.diff(of_slot, prepend=-1) | np.diff(passes, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(at)]):
            s = of_slot[a]
            blocks[a:b] = permuted(at[a:b], int(of["blocks"][s]), seed, int(of["sid"][s]), int(passes[a]))
        ends = turn == of["slots"][of_slot] - 1
        return pd.DataFrame({
            "shard": shard, "slot": where[first : first + len(at)], "sid": of["sid"][of_slot],
            "pass": passes, "block": blocks, "_words": np.where(ends, of["last"][of_slot], block),
        })

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for gid, part, rows in zip(pdf["gid"], pdf["part"], pdf["of"]):
                of = {f: np.array([r[f] for r in rows], np.int64) for f in fields}
                for shard in range(part * shards // parts, (part + 1) * shards // parts):
                    yield drawn(shard, int(gid), of)

    work = grouped.select("gid", "of", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    schema = "shard int, slot long, sid long, pass int, block long, _words long"
    tasks = min(parts, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return work.repartition(tasks, "gid", "part").mapInPandas(fill, schema)


def taken(df: DataFrame, **options) -> DataFrame:
    """The documents of ``mix`` with ``taken``: the words of each that the mix takes."""
    documents, spans = mix(df, **options)
    sums = spans.groupBy("sid", "start").agg(F.sum("words").alias("taken"))
    key = F.when(F.col("size") > 0, F.col("start"))
    return (
        documents.withColumn("start", key)
        .join(sums, ["sid", "start"], "left")
        .withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )
