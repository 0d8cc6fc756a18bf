import math
import re
from collections import Counter

import numpy as np
import pytest

from srcgauge.llm import lexical
from srcgauge.llm.catalog import op13_document_fp_tree
from srcgauge.llm.lexical import Tree, gain, rank_documents, term_counts
from tests.llm.conftest import SMALL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every document scored for every item."""
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        wanted, found = Counter(terms_of(text)), []
        for doc, bag, n in bags:
            m = 100 - 75 + (75 * n * n_docs) // length
            score = 0
            for t, times in wanted.items():
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda f: f[:3])
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, k=10):
    docs = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, rank string")
    items = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, item string")
    return sorted(map(tuple, rank_documents(docs.repartition(3), items, k).collect()), key=str)


def test_query_against_brute_force(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(map(tuple, op13_document_fp_tree(spark, SMALL).collect()), key=str)
    assert got == brute([(d["doc_id"], d["text"]) for d in documents], items)


@pytest.mark.parametrize("tree_docs,leaf_docs", [(5, 1), (40, 4), (16_384, 16)])
def test_random_documents_against_brute_force(spark, monkeypatch, tree_docs, leaf_docs):
    monkeypatch.setattr(lexical, "TREE_DOCS", tree_docs)
    monkeypatch.setattr(lexical, "LEAF_DOCS", leaf_docs)
    rng = np.random.default_rng(tree_docs)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ä", "ä", "日本", "9"]
    draw = lambda n: " ".join(vocabulary[int(44 * u * u)] for u in rng.random(n))
    docs = [(int(i), draw(rng.integers(0, 30))) for i in rng.permutation(150)]
    docs += [(200 + i, "w1 w2 w40") for i in range(60)]  # copies: ties go by id
    items = [(i, draw(rng.integers(1, 12))) for i in range(25)] + [(99, "w1-w2, W40!")]
    assert ranked(spark, docs, items) == brute(docs, items)


def test_bounds_hold_and_prune():
    """Few documents are scored where scores differ, and none that belongs is left out."""
    rng = np.random.default_rng(0)
    n, v = 3000, 300
    terms = [np.unique((v * rng.random(25) ** 2).astype(np.int64)) for _ in range(n)]
    tfs = [rng.integers(1, 9, len(t)) for t in terms]
    m = rng.integers(30, 300, n)
    weights = np.arange(1, v + 1) * 20
    ids = list(range(n))
    tree = Tree(terms, tfs, m, np.arange(n, dtype=np.uint64), weights)
    shares = []
    for _ in range(20):
        counts = np.zeros(v, np.int64)
        counts[rng.integers(0, v, 12)] = 1
        exact = [int((counts[t] * weights[t] * gain(f, mm)).sum()) for t, f, mm in zip(terms, tfs, m)]
        best = []
        shares.append(tree.search(counts, best, 10, ids) / n)
        want = sorted(((s, -i) for i, s in enumerate(exact) if s > 0), reverse=True)[:10]
        assert sorted((b[:2] for b in best), reverse=True) == want
    assert np.mean(shares) < 0.7


def test_large_numbers_stay_exact(spark):
    docs = [(i, "rare " * (i + 1) + "filler " * 2000) for i in range(3)]
    items = [(1, "rare " * 300_000)]
    assert ranked(spark, docs, items) == brute(docs, items)


def test_items_in_several_blocks(spark, monkeypatch, documents):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)
    items = [(i, "The of And que los der") for i in range(12)] + [(50, "inatis der den")]
    docs = [(d["doc_id"], d["text"]) for d in documents[:60]]
    assert ranked(spark, docs, items, 3) == brute(docs, items, 3)


def test_nulls_repeats_ties_and_empty_tables(spark):
    docs = [(None, "alpha beta"), (None, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (1, None), (2, ""), (4, "--")]
    docs += [(2**63 - 1, "alpha beta"), (-5, "alpha beta"), (9, "gamma " * 400_000)]
    items = [(1, "ALPHA alpha"), (1, "gamma"), (2, None), (3, "nowhere"), (None, "beta")]
    got = ranked(spark, docs, items, 4)
    assert got == brute(docs, items, 4)
    assert ranked(spark, docs, [(7, "alpha")], 10)[-1][2] is None
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rank_documents(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_empty_items(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    got = rank_documents(docs, spark.createDataFrame([], "item_id long, text string"))
    assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_of_long_texts(monkeypatch):
    text = "Äb, C3:d　e é" * 500 + "x" * 5000
    whole = Counter(t.encode() for t in terms_of(text))
    assert term_counts(text) == whole
    monkeypatch.setattr(lexical, "WINDOW", 7)
    assert term_counts(text) == whole
