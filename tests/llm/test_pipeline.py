import pytest

import corpus_pipeline
from srcgauge.sources.tables import table
from tests.llm.brute import groups
from tests.llm.test_packing import check

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage leaves, starting with the documents."""
    docs = table(spark, MIDDLE, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], MIDDLE), "test"))
    return out


def test_stages_keep_columns_and_only_filter(stages):
    docs = stages[0].collect()
    for after in stages[1:4]:
        assert after.columns == stages[0].columns
        assert set(after.collect()) <= set(docs)


def test_clean_documents_stay(spark, stages):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages[:4]]
    labels = {r.doc_id: r.toxic for r in table(spark, MIDDLE, "labels").collect()}
    assert len(ids[0] - ids[1]) <= 0.005 * len(ids[0])
    assert sum(labels.get(i) == 0 for i in ids[1] - ids[2]) <= 2
    assert sum(labels.get(i) == 1 for i in ids[1] - ids[2]) >= 25


def test_one_document_of_each_group_stays(stages):
    texts = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {i for i, (_, first) in groups(texts, 5).items() if i == first}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_everything_kept_is_packed(stages):
    check(stages[4].collect(), [(r.doc_id, r.text) for r in stages[3].collect()], 2048)


def test_edge_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"the quiet dog number {i} and the cat " * 3, "en", "s", 9) for i in range(30)]
    rows += [(90, None, "en", "s", 0), (91, "", None, None, None), (92, "12 + 3", "en", "s", 6)]
    rows += [(None, "the cat and the dog", "en", "s", 9), (5, rows[5][1], "en", "s", 9)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, MIDDLE), "test")
    ids = [r.doc_id for r in docs.collect()]
    assert ids.count(5) == 1 and ids.count(None) == 1 and not {90, 91, 92} & set(ids)
    empty = docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, MIDDLE)
    assert empty.count() == 0


def test_different_texts_of_one_id_stay(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, component_id int"
    one, two, other = ("".join(f"{w}{i} " for i in range(60)) for w in "abc")
    near = one + "more"
    rows = [(3, one), (5, near), (5, two), (5, two), (8, two), (9, other), (9, ""), (None, one), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, 1) for i, t in rows], schema)
    got = corpus_pipeline.near_duplicate(spark, docs, MIDDLE)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    want = [(3, one), (5, two), (9, other), (9, ""), (None, one), (2, None)]
    assert sorted((r.doc_id or 0, r.text or "-") for r in got.collect()) == sorted((i or 0, t or "-") for i, t in want)


def test_long_text_passes_the_stages(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"the quiet dog number {i} and the cat " * 3, "en", "s", 9) for i in range(30)]
    rows.append((50, " ".join(f"the quiet dog and cat {i % 977} {i}" for i in range(40_000)), "en", "s", 9))
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, MIDDLE), "test")
    assert docs.filter("doc_id = 50").count() > 1
