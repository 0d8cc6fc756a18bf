import math

import numpy as np
import pyarrow.dataset as ds
import pytest

from srcgauge.llm import balltree, forest, shards
from srcgauge.llm.balltree import exact_top_k
from srcgauge.llm.catalog import op2_projection_forest, op9_ball_tree
from srcgauge.llm.forest import nearest
from tests.llm.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(rows, k, measure):
    """{query id: [(vec_id, score)]} by comparing all pairs."""
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            found = [(-measure(x, y), v) for v, y in rows if v != q]
            out[q] = [(v, -s) for s, v in sorted(found)[:k]]
    return out


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def vectors():
    table = ds.dataset(f"{SMALL}/embeddings.parquet").to_table()
    ids = table["vec_id"].to_numpy()
    return ids, np.array(table["embedding"].to_pylist(), np.float64)


def test_exact_query(spark, vectors):
    ids, matrix = vectors
    whole = np.floor(64 * matrix)
    rows = list(zip(ids.tolist(), whole, strict=True))
    want = brute(rows, 20, lambda a, b: int(a @ b))
    assert grouped(op9_ball_tree(spark, SMALL).collect()) == want


def test_exact_with_several_shards_ties_and_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6))
    data = [(i, (centres[i % 5] + 0.1 * rng.normal(size=6)).astype(np.float32)) for i in range(900)]
    data += [(900 + i, data[20][1]) for i in range(60)]  # equal vectors
    df = spark.createDataFrame([(i, x.tolist(), "s", 1) for i, x in data], SCHEMA).repartition(5)
    rows = [(i, np.floor(64 * x.astype(np.float64))) for i, x in data]
    assert grouped(exact_top_k(df, 7).collect()) == brute(rows, 7, lambda a, b: int(a @ b))


def test_bound_prunes_subtrees(monkeypatch):
    """Clustered data: most leaves are never scored, and results stay exact."""
    monkeypatch.setattr(balltree, "LEAF_ROWS", 16)
    rng = np.random.default_rng(1)
    rows = np.repeat(rng.normal(size=(40, 8)) * 100, 50, axis=0).round()
    rows += rng.integers(-2, 3, rows.shape)
    tree = balltree.build(np.arange(len(rows)), rows, 0)
    scored = []
    products = balltree._products
    monkeypatch.setattr(
        balltree, "_products", lambda a, b: scored.append(len(a) * len(b)) or products(a, b)
    )
    queries = rows[:1]
    at, found, score = balltree.search(tree, np.array([-1]), queries, np.array([-np.inf]), 5)
    assert sum(scored) < len(rows) / 3
    assert score.tolist() == sorted((rows @ queries[0]).tolist(), reverse=True)[:5]


def test_many_small_shards_and_blocks(spark, monkeypatch):
    """Whatever the tiles, the best are exact; a tile returns k rows of a query at most, also
    where it has many shards, so rows grow with the tiles and not with the shards."""
    monkeypatch.setattr(shards, "TILE_BLOCKS", 3)
    monkeypatch.setattr(shards, "TILE_SHARDS", 8)
    monkeypatch.setattr(shards, "TILES_A_CORE", 0)
    tiles, store, made = [], shards.search_tiles, []
    monkeypatch.setattr(
        shards, "search_tiles", lambda *a: tiles.append(a[1]) or made.append(store(*a)) or made[-1]
    )
    rng = np.random.default_rng(8)
    data = [(i, rng.normal(size=5).round(3).tolist()) for i in range(1200)]
    data += [(i, rng.normal(size=3).round(3).tolist()) for i in range(1200, 1300)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    vectors = df.selectExpr("vec_id", "transform(embedding, x -> cast(floor(64 * x) as double)) as vector")
    asked = vectors.vec_id % 20 == 0
    result = shards.search_all(
        vectors, asked, balltree.build, balltree.search, 7, shard_rows=32, block_rows=8, kind="long"
    )
    whole = [(i, np.floor(64 * np.array(x))) for i, x in data]
    want = {}
    for size in (5, 3):
        want |= brute([r for r in whole if len(r[1]) == size], 7, lambda a, b: int(a @ b))
    assert grouped(result.collect()) == want
    blocks, rest = tiles  # one home each, then groups of blocks by groups of shards
    assert blocks >= 6 and rest <= 15
    assert made[1].count() <= 65 * 7 * 6


def test_shards_take_the_least_bytes_and_one_row_a_group(spark, tmp_path):
    numbers = np.array([[1.0, -128.0], [64.0, 3.0]])
    for top, kind in ((127, np.int8), (30_000, np.int16), (1 << 30, np.int32), (1 << 40, np.float32)):
        small = shards.narrowed(np.append(numbers[:, :1], [[float(top)]], axis=0))
        assert small.dtype == kind and small.max() == top
    assert shards.narrowed(np.array([[0.1]])).dtype == np.float64
    assert shards.narrowed(np.array([[2.0**53 + 2]])).dtype == np.float64
    vectors = spark.range(0, 40_000, 1, 1).selectExpr("id as vec_id", "transform(sequence(1, 64), x -> rand(3)) as vector")
    made = shards.in_shards(vectors, lambda ids, m, _: (ids, m), 10_000)
    made.write.options(**shards.LARGE_ROWS).parquet(f"{tmp_path}/x")
    groups = [g.num_rows for f in ds.dataset(f"{tmp_path}/x").get_fragments() for g in f.row_groups]
    assert sum(groups) == 4 and max(groups) <= 3


def test_forest_query_recall_and_scores(spark, vectors):
    ids, matrix = vectors
    found = grouped(op2_projection_forest(spark, SMALL).collect())
    by_id = dict(zip(ids.tolist(), matrix, strict=True))
    want = brute(list(by_id.items()), 20, lambda a, b: float(a @ b))
    assert found.keys() == want.keys()
    hit = sum(len({v for v, _ in found[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.9
    for q, rows in found.items():
        assert all(math.isclose(s, float(by_id[q] @ by_id[v]), abs_tol=1e-12) for v, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_forest_recall_in_a_large_shard():
    """Isotropic vectors, the hardest case: recall at least 0.9."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(6000, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    index = forest.build(np.arange(6000), rows, 0)
    queries = np.arange(0, 6000, 60)
    at, found, _ = forest.search(index, queries, rows[queries], np.full(100, -np.inf), 20)
    products = rows[queries] @ rows.T
    products[np.arange(100), queries] = -9
    want = np.argsort(-products, axis=1)[:, :20]
    hit = sum(len(set(found[at == i]) & set(want[i])) for i in range(100))
    assert hit / 2000 >= 0.9


@pytest.mark.parametrize("operator", [nearest, exact_top_k])
def test_edge_rows(spark, operator):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 0.5]), (20, [0.5, 1.0]), (40, None), (60, []), (1, [1.0, 0.25]),
        (1, [1.0, 0.25]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [1.0, None]), (5, [0.0, 0.0]),
        (None, [1.0, 1.0]), (80, [1.0, 2.0, 3.0]), (6, [1.0, 1.0, 1.0]),
    ]
    df = spark.createDataFrame([(i, x, "s", 1) for i, x in data], SCHEMA)
    found = grouped(operator(df, 3).collect())
    assert [v for v, _ in found[80]] == [6]
    exact = operator is exact_top_k
    assert [v for v, _ in found[0]] == ([1, 20, 5] if exact else [1, 20])
    assert set(found) == {0, 20, 80}
    assert operator(df.limit(0), 3).count() == 0


def test_large_whole_scores_stay_apart(spark):
    """Scores beyond 2^53 that doubles would hold to be equal."""
    big = 2.0**23  # 64 times it squared is 2^58
    rows = [(0, [big, 1 / 64]), (1, [big, 1 / 64]), (2, [big, 2 / 64]), (3, [big, 0.0]), (4, [-big, 3 / 64])]
    got = [tuple(r) for r in exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    top = 2**58
    assert sorted(got) == [(0, 1, 2, top + 2), (0, 2, 1, top + 1), (0, 3, 3, top), (0, 4, 4, 3 - top)]
