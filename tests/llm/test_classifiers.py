import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from srcgauge.llm.catalog import op4_log_ratio_toxicity, op5_kneser_ney_language
from srcgauge.llm.language import GAP, language_id, learn, sequences
from srcgauge.llm import language as language_module
from srcgauge.llm import toxicity as toxicity_module
from srcgauge.llm.toxicity import BUCKET_BITS, features, occurrences, toxicity

MIDDLE = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


@pytest.fixture(scope="module")
def middle():
    return {r["doc_id"]: r for r in ds.dataset(f"{MIDDLE}/documents.parquet").to_table().to_pylist()}


def test_language_query_on_the_held_fold(spark, middle):
    rows = op5_kneser_ney_language(spark, MIDDLE).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(middle))
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == middle[r.doc_id]["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) < 0.005 * len(rows)


def test_toxicity_query_on_the_held_fold(spark):
    """Few toxic words are in this table often enough to be learned; none is given."""
    labels = ds.dataset(f"{LARGE}/labels.parquet").to_table().to_pylist()
    toxic = {r["doc_id"]: r["toxic"] for r in labels}
    rows = op4_log_ratio_toxicity(spark, LARGE).collect()
    ids = ds.dataset(f"{LARGE}/documents.parquet").to_table(["doc_id"])["doc_id"].to_pylist()
    assert Counter(r.doc_id for r in rows) == Counter(ids)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    wrong = sum(r.predicted != toxic[r.doc_id] for r in held)
    assert wrong / len(held) < 0.025
    scores = [[r.score for r in held if toxic[r.doc_id] == label] for label in (0, 1)]
    assert np.mean([t > c for t in scores[1] for c in scores[0]]) > 0.97
    clean = [r for r in held if not toxic[r.doc_id]]
    assert sum(r.predicted for r in clean) / len(clean) < 0.005


def test_sequences():
    keys, sizes = sequences(["Ab", "", "  ..", "x--y "])
    text = [
        "".join(chr(int(k) >> s & 0xFFFF) for s in (48, 32, 16, 0)) for k in keys.tolist()
    ]
    assert sizes.tolist() == [3, 0, 0, 4]
    assert text == ["   a", "  ab", " ab ", "   x", "  x ", " x y", "x y "]
    assert chr(GAP) == " "


def test_probabilities_are_kneser_ney_and_sum_to_one():
    """Log probabilities of the tables equal the recursive definition."""
    texts = ["abab abba", "baab bab a", "caba"]
    keys, _ = sequences(texts)
    counted = np.unique(keys, return_counts=True)
    models = learn({"x": counted, "y": np.unique(sequences(["zzz y"])[0], return_counts=True)})
    grams = [{}, {}, {}, {}]
    unpack = lambda k: tuple(int(k) >> s & 0xFFFF for s in (48, 32, 16, 0))
    grams[3] = {unpack(k): int(n) for k, n in zip(*counted, strict=True)}
    for n in (2, 1, 0):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    letters = {g[0] for g in grams[0]}
    vocabulary = letters | {ord("z"), ord("y"), ord(" ")}

    def p(g):
        if not g:
            return 1 / (len(vocabulary) + 1)
        table = grams[len(g) - 1]
        once = sum(v == 1 for v in table.values())
        twice = sum(v == 2 for v in table.values())
        d = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        followers = [v for k, v in table.items() if k[:-1] == g[:-1]]
        if not followers:
            return p(g[1:])
        total = sum(followers)
        return max(table.get(g, 0) - d, 0) / total + d * len(followers) / total * p(g[1:])

    i = models.languages.index("x")
    for context in [(32, 97, 98), (97, 98, 97), (122, 122, 97), (5, 6, 7)]:
        all_ = [*vocabulary, 9999]
        packed = np.array(
            [sum(c << s for c, s in zip((*context, x), (48, 32, 16, 0), strict=True)) for x in all_],
            np.uint64,
        )
        got = models.log_probabilities(packed)[:, i]
        assert np.allclose(got, [math.log(p((*context, x))) for x in all_], atol=1e-5)
        assert math.isclose(np.exp(got).sum(), 1, rel_tol=1e-4)


def test_features_stay_inside_a_text():
    texts = ["abcdefg", "abc", "", "ABCDEFG"]
    text, bucket = features(texts, np.ones(1 << BUCKET_BITS, bool))
    assert [f.tolist() for f in occurrences(texts)] == [bucket[text == i].tolist() for i in range(4)]
    assert Counter(text.tolist()) == {0: 3 + 2 + 1, 3: 6}
    assert bucket[text == 0].tolist() == bucket[text == 3].tolist()


def test_language_edge_rows(spark, frame):
    rows = [(i, "the cat and the dog " * 3, "en", "s", 1) for i in range(8)]
    rows += [(20 + i, "der hund und die katze " * 3, "de", "s", 1) for i in range(8)]
    rows += [(50, None, "en", "s", 1), (51, "123 !", "en", "s", 1), (52, "", None, "s", 1)]
    rows += [(None, "the dog", None, "s", 1), (53, "katze " * 30_000, None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, held_out int")
    got = {r.doc_id: r for r in language_id(df).collect()}
    assert len(got) == len(rows)
    assert [got[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3
    assert all(got[i].rejected and got[i].score == 0 for i in (50, 51, 52))
    assert got[None].lang_pred == "en" and got[53].lang_pred == "de"
    assert language_id(df.limit(0)).count() == 0
    alone = language_id(df.withColumn("lang", df.lang.substr(100, 1)).filter("doc_id = 0"))
    assert alone.count() == 1


def test_toxicity_edge_rows(spark, frame):
    rows = [(i, "kind words here" if i % 2 else "kind idiot words") for i in range(60)]
    rows += [(100, None), (101, ""), (None, "idiot"), (102, "idiot " * 30_000), (103, "ab")]
    labels = [(i, None if i == 7 else 1 - i % 2, 5) for i in range(60)] + [(None, 1, 5), (0, 0, 5)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    df = frame(rows)
    got = {r.doc_id: r for r in toxicity(df, marks).collect()}
    assert len(got) == len(rows)
    assert got[None].score > 0.5 > got[1].score
    assert got[102].predicted == 1 and 0 <= got[100].score == got[101].score < 0.7
    one_class = toxicity(df, marks.filter("toxic = 0")).collect()
    assert all(0 <= r.score < 0.5 for r in one_class)
    assert toxicity(df.limit(0), marks.limit(0)).count() == 0


def wide_vocabulary(spark):
    """30 toxic texts of the same 200 long words (some 7,000 n-grams), 12 of one other
    word, 100 clean ones."""
    draw = random.Random(1)
    hot = " ".join("".join(draw.choices("abcdefghijklmnop", k=12)) for _ in range(200))
    texts = [hot] * 30 + ["some zyxquark words"] * 12 + ["some kind words"] * 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 42)) for i in range(142)], "doc_id long, toxic int")
    return docs, marks


def test_rare_toxic_words_count_beside_a_wide_vocabulary(spark):
    docs, marks = wide_vocabulary(spark)
    model = toxicity_module.learned(docs, marks)
    assert (model.weights != 0).sum() > 4_000
    rare, clean, none = model.scores(["some zyxquark words", "some kind words", ""])
    assert rare > 0.5 > clean and rare > none


def test_steps_as_jobs_give_the_same_model(spark, monkeypatch):
    docs, marks = wide_vocabulary(spark)
    monkeypatch.setattr(toxicity_module, "LEARN_STEPS", 5)
    held = toxicity_module.train(docs, marks)
    monkeypatch.setattr(toxicity_module, "SUMMED_AT_ONCE", 1_000)
    spread = toxicity_module.train(docs, marks, held_occurrences=0)
    assert np.allclose(held.weights, spread.weights, atol=1e-6) and np.isclose(held.bias, spread.bias)


def test_models_of_what_was_seen_give_the_same(monkeypatch):
    texts = {"a": "abab abba cab", "b": "zzz y abba", "c": "xyz xyz"}
    counted = {k: np.unique(sequences([t])[0], return_counts=True) for k, t in texts.items()}
    probes = ["abab zy", "", "qq abba", "x" * 50, "new words"]
    full, letters = learn(counted).cross_entropies(probes)
    monkeypatch.setattr(language_module, "FULL_NUMBERS", 0)
    monkeypatch.setattr(language_module, "STEP_NUMBERS", 7)
    seen, same = learn(counted).cross_entropies(probes)
    assert np.allclose(full, seen, atol=1e-4) and (letters == same).all()


def test_every_language_is_learned(spark):
    """More than 200 languages of one short text, and ten of three long ones each."""
    draw = random.Random(2)
    words = lambda n: " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(n))
    rows = [(f"s{i:03}", words(6)) for i in range(210)]
    rows += [(f"long{i}", words(6_000)) for i in range(10) for _ in range(3)]
    rows = [(i, text, lang) for i, (lang, text) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_module.train(docs, F.lit(True), learn_chars=4_000)
    assert models.languages == sorted({lang for _, _, lang in rows})
