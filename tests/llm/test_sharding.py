from collections import Counter

import numpy as np

from srcgauge.llm.catalog import op7_hypergeometric_sharding
from srcgauge.llm.sharding import (
    _draw_one, blocks_of, communication_row, shuffle_into_shards, sizes_of,
)
from tests.llm.conftest import SMALL


def test_matrix_has_exact_margins():
    counts, (_, columns) = np.array([5, 0, 17, 3]), blocks_of(sizes_of(25, 3), 4)
    rows = np.array([communication_row(p, counts, columns, 1) for p in range(4)])
    assert rows.sum(1).tolist() == counts.tolist()
    assert rows.sum(0).tolist() == columns.tolist()


def test_large_population_draws_agree_with_the_law():
    rng = np.random.default_rng(0)
    good, bad, n = 3 * 10**9, 10**9, 10**6
    drawn = np.array([_draw_one(rng, good, bad, n) for _ in range(2000)])
    assert abs(drawn.mean() - 750_000) < 60
    assert 0.9 < drawn.std() / 433.0 < 1.1


def test_query_is_whole_and_gapless(spark, documents):
    rows = op7_hypergeometric_sharding(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d["doc_id"] for d in documents)
    sizes = {d["doc_id"]: len((d["text"] or "").encode()) + 1 for d in documents}
    assert all(r.size == sizes[r.doc_id] for r in rows)
    slots = [sorted(r.slot for r in rows if r.shard == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in slots)
    assert max(map(len, slots)) - min(map(len, slots)) <= 1


def test_places_are_uniform(spark):
    """Every row lands on every (shard, slot) about equally often over seeds."""
    df = spark.range(6, numPartitions=3).coalesce(3)
    seen = Counter()
    for seed in range(12):
        for r in shuffle_into_shards(df, 2, seed).collect():
            seen[r.id, r.shard] += 1
    assert all(1 <= seen[i, s] <= 11 for i in range(6) for s in range(2))


def test_nulls_repeats_and_empty_tables(spark, frame):
    df = frame([(1, None), (1, None), (None, ""), (7, "a" * 100_000)])
    rows = shuffle_into_shards(df, 3).collect()
    assert Counter(r.shard for r in rows) == {0: 2, 1: 1, 2: 1}
    assert shuffle_into_shards(df.limit(0), 3).count() == 0


def test_columns_named_like_the_steps_stay(spark):
    columns = ["_at", "_PART", "_block", "__at", "count", "shard", "slot"]
    df = spark.createDataFrame([tuple(range(i, i + 7)) for i in range(50)], columns).repartition(3)
    rows = shuffle_into_shards(df, 4).collect()
    kept = columns[:5]
    assert sorted(tuple(r[c] for c in kept) for r in rows) == [tuple(range(i, i + 5)) for i in range(50)]
    assert sorted(Counter(r.shard for r in rows).values()) == [12, 12, 13, 13]


def test_places_follow_the_uniform_law(spark):
    """Chi-squared over rows and places, of many seeds: within four standard deviations."""
    df, seen, seeds = spark.range(8, numPartitions=2).coalesce(2), Counter(), 60
    for seed in range(seeds):
        for r in shuffle_into_shards(df, 2, seed, block_rows=2).collect():
            seen[r.id, 4 * r.shard + r.slot] += 1
    expected = seeds / 8
    chi = sum((seen[i, p] - expected) ** 2 / expected for i in range(8) for p in range(8))
    assert abs(chi - 49) < 4 * (2 * 49) ** 0.5
