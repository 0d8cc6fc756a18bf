import random

import numpy as np
import pytest

from srcgauge.llm import neardup
from srcgauge.llm.catalog import op6_super_minhash
from srcgauge.llm.neardup import components, near_duplicates, shingles, signatures
from tests.llm.brute import groups, shingle_set
from tests.llm.conftest import SMALL

np.seterr(over="ignore")


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.fixture(scope="module")
def families():
    """Families of edited copies, some of them near the limit, and shared passages."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([8, 40, 120]))
        for edits in [0, 0, 1, 2, 3, 5, 8, 13]:
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        texts.append(" ".join(passage + base[:40]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [2, 5])
def test_groups_equal_brute_force(frame, families, size):
    df = frame(families).repartition(3)
    assert found(near_duplicates(df, size)) == groups(families, size)


def test_query(spark, documents):
    texts = [(d["doc_id"], d["text"]) for d in documents]
    assert found(op6_super_minhash(spark, SMALL)) == groups(texts, 2)


def test_shingles_equal_sets():
    texts = ["A b a B  a b", "", "one", "É é x\tY\x0bz", "a b c " * 50]
    for size in (1, 2, 5):
        owner, _ = shingles(texts, size)
        want = [len(shingle_set(t, size)) for t in texts]
        assert np.bincount(owner, minlength=len(texts)).tolist() == want


def test_signatures_estimate_similarity_with_low_variance():
    """Mean near the similarity, variance at most that of independent hashes."""
    rng = np.random.default_rng(0)
    sizes, errors = (40, 10), []
    for _ in range(300):
        x = rng.integers(1, 1 << 63, sum(sizes), dtype=np.uint64)
        sets = [x[: sizes[0]], x[10:]]  # 30 shared of 50
        owner = np.repeat([0, 1], [len(s) for s in sets])
        best = signatures(owner, np.concatenate(sets), 2)
        errors.append((best[0] == best[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.6 * 0.4 / 128


def test_signature_does_not_depend_on_the_batch():
    x = np.arange(1, 40, dtype=np.uint64)
    alone = signatures(np.zeros(39, np.int64), x, 1)
    other = signatures(np.r_[np.zeros(39, np.int64), 1], np.r_[x, np.uint64(5)], 3)
    assert (other[0] == alone[0]).all()
    assert (other[2] == np.iinfo(np.uint64).max).all()


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 7)]
    random.Random(1).shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    roots = {r.node: r.root for r in components(df, "test").collect()}
    assert {roots[i] for i in range(101, 161)} == {100}
    assert {roots[i] for i in [*range(7, 60)]} == {3}


def test_no_table_is_broadcast(frame, families, monkeypatch):
    """Whatever the files' sizes, no join sends a table through the driver."""
    plans = []
    store = neardup.stored

    def seen(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, purpose)

    monkeypatch.setattr(neardup, "stored", seen)
    result = near_duplicates(frame(families).repartition(3), 2)
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    assert found(result) == groups(families, 2)
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def test_components_of_stars_take_no_step(spark, monkeypatch):
    """Links that are stars already are written once; equal links of two splits are one."""
    purposes = []
    store = neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, p: purposes.append(p) or store(df, p))
    stars = spark.createDataFrame([(1, 2), (1, 3), (5, 9)], "a long, b long")
    assert sorted(map(tuple, components(stars.coalesce(1), "one").collect())) == [(2, 1), (3, 1), (9, 5)]
    assert purposes == ["one"]
    twice = stars.unionByName(stars)
    assert sorted(map(tuple, components(twice, "two").collect())) == [(2, 1), (3, 1), (9, 5)]
    assert components(stars.limit(0), "none").count() == 0


def test_edge_rows(frame):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one"), (6, "one"),
        (None, "one"), (7, "x y " * 20_000), (8, "X Y " * 20_000), (9, "other words here"),
    ]
    df = near_duplicates(frame(rows), 2)
    result = sorted(tuple(r) for r in df.collect() if r.doc_id is not None)
    assert result == [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
        (6, 1, 4, False), (6, 1, 4, False), (7, 2, 7, True), (8, 2, 7, False), (9, 2, 9, True),
    ]
    assert [r.kept for r in df.filter("doc_id is null").collect()] == [True]
    assert near_duplicates(frame(rows).limit(0)).count() == 0
