import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from srcgauge.llm.catalog import op12_source_mix
from srcgauge.llm.mixing import mix, permuted, shard_counts, shard_start, slots_of, taken, word_count
from tests.llm.conftest import SMALL

SCHEMA = "doc_id long, text string, source string, size string, sid string, shard string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares in code-point order, null last; a source that is full leaves the rest to the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), Fraction(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: Fraction(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations_and_their_inverses(n):
    seen = [permuted(np.arange(n), n, 1, 2, turn) for turn in range(3)]
    for turn, places in enumerate(seen):
        assert sorted(places) == list(range(n))
        assert (permuted(places, n, 1, 2, turn, back=True) == np.arange(n)).all()
    assert n < 64 or not (seen[0] == seen[1]).all()


def test_slots_give_the_target_to_the_word():
    rng = np.random.default_rng(3)
    for size, block in [(1, 4), (8, 4), (9, 4), *zip(rng.integers(1, 300, 40), [7] * 40)]:
        for words in {0, 1, size, 3 * size, *rng.integers(0, 3 * size + 1, 5)}:
            size, words = int(size), int(words)
            blocks, slots, last = slots_of(size, words, block, 5, 6)
            got = []
            for g in range(slots):
                place = np.array([g % blocks])
                b = int(permuted(place, blocks, 5, 6, g // blocks)[0])
                got.append(min(block, size - b * block))
            assert slots <= 3 * blocks
            assert sum(got[:-1]) + min(last, got[-1] if got else 0) == words


def test_counts_of_shards_add_up_and_follow_the_law():
    groups, quotas = np.array([60, 40]), np.array([45, 15])
    seen = []
    for seed in range(400):
        rows = [shard_counts(k, 7, groups, 0, quotas, seed) for k in range(7)]
        assert [r[0].sum() for r in rows] == [shard_start(k + 1, 100, 7) - shard_start(k, 100, 7) for k in range(7)]
        assert (sum(r[1] for r in rows) == quotas).all()
        assert all(r[1].sum() == r[0][0] for r in rows)
        assert (rows[3][2] == sum(r[1] for r in rows[:3])).all()
        seen.append(rows[2][1][0])
    n, p = 14, 0.45  # slots of shard 2, share of the source
    assert abs(np.mean(seen) - n * p) < 0.3
    assert 0.8 < np.var(seen) / (n * p * (1 - p) * (100 - n) / 99) < 1.25


def test_query_against_targets(spark, documents):
    rows = op12_source_mix(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d["doc_id"] for d in documents)
    source = {d["doc_id"]: d["source"] for d in documents}
    sizes, got = Counter(), Counter()
    for d in documents:
        sizes[d["source"]] += len(words_of(d["text"]))
    want = targets(sizes)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        assert 0 <= r.taken <= 3 * r.size
        got[s] += r.taken
    assert all(abs(got[s] - want[s]) <= 0.5 for s in sizes)
    again = op12_source_mix(spark, SMALL).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def make(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def test_spans_against_a_plain_version(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(n)), "abc"[i % 3]) for i, n in enumerate(rng.integers(0, 90, 60))]
    rows += [(7, "x y z " * 300, "c"), (8, "one  two\tthree", "big"), (8, "one  two\tthree", "big")]
    df = make(spark, rows)
    docs, spans = mix(df, block_words=8, shard_slots=16)
    docs, spans = docs.collect(), spans.collect()
    stream = defaultdict(list)  # words of a source in order: (row, word)
    for at, d in enumerate(sorted(docs, key=lambda d: (d.sid, d.start, d.size))):
        assert len(stream[d.sid]) == d.start
        stream[d.sid] += [(d.doc_id, d.start, w) for w in range(d.size)]
    slots = defaultdict(list)
    for s in spans:
        slots[s.shard, s.slot].append(s)
    shards = Counter(shard for shard, _ in slots)
    assert max(shards.values()) - min(shards.values()) <= 1 and max(shards.values()) <= 16
    used = set()
    for (shard, slot), parts in slots.items():
        parts.sort(key=lambda s: s.offset)
        sid, block = parts[0].sid, parts[0].block
        assert slot < shards[shard] and len({(s.sid, s["pass"], s.block) for s in parts}) == 1
        use = (sid, parts[0]["pass"], block)
        assert use not in used and use[1] < 3
        used.add(use)
        words = [(s.doc_id, s.start, w) for s in parts for w in range(s.first, s.first + s.words)]
        assert words == stream[sid][block * 8 : block * 8 + len(words)]
    cut = Counter((s.sid) for s in spans)
    assert set(cut) == set(stream)
    for d in docs:
        got = sum(s.words for s in spans if s.sid == d.sid)
        assert got == int(np.floor(d.target + 0.5))


def test_scarce_sources_stop_at_three_passes(spark):
    df = make(spark, [(1, "a b", "a"), (2, "c " * 500, "b"), (3, "d " * 500, None)])
    rows = {r.doc_id: r for r in taken(df, block_words=4, shard_slots=8).collect()}
    assert rows[1].taken == rows[1].target == 6
    want = targets({"a": 2, "b": 500, None: 500})
    assert all(abs(rows[i].target - want[s]) < 1e-9 for i, s in [(2, "b"), (3, None)])
    assert rows[2].taken == round(want["b"]) and rows[3].source is None


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, None), (1, None, None), (None, "", "s"), (4, " \t\n", "s")]
    got = taken(make(spark, rows)).collect()
    assert len(got) == 4 and all((r.size, r.taken, r.target) == (0, 0, 0.0) for r in got)
    assert taken(make(spark, rows).limit(0)).count() == 0
    long = "word " * 400_000
    got = taken(make(spark, [(5, long, "s"), (5, long, "s")])).collect()
    assert [r.taken for r in got] == [400_000, 400_000]


def test_word_count(spark):
    texts = ["", " ", "a", " a b\x0bc\x0c\r\nd ", "é ü 　x", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.n for r in df.select(word_count("text").alias("n")).collect()] == [len(words_of(t)) for t in texts]
