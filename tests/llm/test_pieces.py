import hashlib
import time

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from srcgauge.llm.catalog import PIECE_BPE, op8_prefix_table_pieces
from srcgauge.llm.pieces import decode, encode, encode_decode, vocabulary
from tests.llm.conftest import SMALL

MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
LIKELY = "ab eth ▁in\n   é日.²_9\t\x00ﬁ"


def same(text):
    ids = MODEL.encode(text)
    assert encode(text, PIECE_BPE) == ids
    assert decode(ids, PIECE_BPE) == MODEL.decode(ids)


@given(st.text(max_size=80) | st.text(LIKELY, max_size=40))
@settings(max_examples=1500, deadline=None)
def test_equals_the_library(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 300, " " * 70, "▁", "a   b    c", "ab" * 5000])
def test_fixed_cases(text):
    same(text)


@given(st.lists(st.tuples(st.integers(0, 70), st.sampled_from(["a", "the", "7", "\n", "é", "雪", "", "/*", "▁"])), max_size=6))
@settings(max_examples=600, deadline=None)
def test_runs_of_spaces(runs):
    same("".join(" " * n + word for n, word in runs))


def test_long_runs_take_time_in_proportion():
    started = time.monotonic()
    same(" " * 1_000_000)
    same("x" + " " * 300_000 + "hello" + " " * 200_001 + "雪")
    assert time.monotonic() - started < 10


@given(st.text("ab ", max_size=30).map(lambda t: t.replace(" ", "▁")), st.integers(1, 3))
@settings(max_examples=300, deadline=None)
def test_merging_takes_the_best_pair_and_the_leftmost_of_equals(text, least):
    vocab, parts = vocabulary(PIECE_BPE), list(text)
    while len(parts) > least:
        pairs = [(vocab.order[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in vocab.order]
        if not pairs:
            break
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert vocab.merged(text, least) == parts


@given(st.lists(st.integers(0, 31_999), max_size=12))
@settings(max_examples=300, deadline=None)
def test_compatible_is_what_merging_gives(ids):
    vocab = vocabulary(PIECE_BPE)
    words = [vocab.piece[i] for i in ids if vocab.piece[i] in vocab.halves and "▁▁" not in vocab.piece[i]]
    for left, right in zip(words, words[1:], strict=False):
        assert vocab.compatible(left, right) == (vocab.merged(left + right) == [left, right])


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, documents):
    rows = {r.doc_id: r for r in op8_prefix_table_pieces(spark, SMALL).collect()}
    assert len(rows) == len(documents)
    for d in documents:
        ids = MODEL.encode(d["text"] or "")
        r = rows[d["doc_id"]]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == digest(",".join(map(str, ids)))
        assert r.decoded_sha256 == digest(MODEL.decode(ids))


def test_edge_rows(spark, frame):
    df = frame([(1, None), (2, ""), (2, ""), (None, "Hello  wörld")])
    rows = encode_decode(df, PIECE_BPE).collect()
    assert sorted((r.n_tokens, r.ids, r.decoded) for r in rows)[:3] == [(0, "", "")] * 3
    assert {r.decoded for r in rows} == {"", "Hello  wörld"}
    assert encode_decode(df.limit(0), PIECE_BPE).count() == 0
