import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from srcgauge.llm.catalog import WORD_BPE, op1_best_fit_packing
from srcgauge.llm.packing import FAN_IN, WordIds, best_fit, carried_bins, pack_documents
from tests.llm.conftest import SMALL

TOKENIZER = Tokenizer.from_file(WORD_BPE)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def check(rows, texts, capacity):
    """Pieces cover the documents, sequences are gapless and within capacity."""
    pieces = {}
    for doc_id, text in texts:
        ids = [*ids_of(text), 0]
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            crc = zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            pieces.setdefault((doc_id, i, at, len(part), crc), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert got == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query(spark, documents):
    rows = op1_best_fit_packing(spark, SMALL).collect()
    made = check(rows, [(d["doc_id"], d["text"]) for d in documents], 2048)
    least = -(-sum(r.length for r in rows) // 2048)
    assert made <= least * 1.03 + 1


def test_tree_over_many_splits(spark, frame):
    """Rounds over 20 tasks need about as few sequences as one task."""
    texts = [(i, "word " * (37 * i % 90)) for i in range(2000)]
    rows = pack_documents(frame(texts).repartition(20), WORD_BPE, 100).collect()
    made = check(rows, texts, 100)
    one = best_fit(np.array([r.length for r in rows]), 100)[0].max() + 1
    assert made <= one * 1.05


def test_edge_rows(spark, frame):
    texts = [(1, None), (1, None), (2, ""), (None, "a b"), (3, "x " * 30_000), (4, "a\x1cb")]
    check(pack_documents(frame(texts), WORD_BPE).collect(), texts, 2048)
    assert pack_documents(frame(texts).limit(0), WORD_BPE).count() == 0


@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
@settings(max_examples=100, deadline=None)
def test_best_fit_leaves_one_bin_half_full(sizes):
    sizes = np.array(sizes)
    bins, offsets = best_fit(sizes, 50)
    fill = np.bincount(bins, weights=sizes)
    assert (fill <= 50).all() and (2 * fill <= 50).sum() <= 1
    assert carried_bins(fill, 50).sum() <= FAN_IN + 1


KNOWN = WordIds(WORD_BPE)
LIKELY = "ab Zé'st 19_²½.,<|>İΣςß\u0301\u00ad\x1c\x85\n日ー٣"


@given(st.text(max_size=60) | st.text(LIKELY, max_size=30))
@settings(max_examples=1500, deadline=None)
def test_word_ids_equal_the_tokenizer(text):
    found = KNOWN.of(text)
    assert list(struct.unpack(f"<{len(found) // 4}I", found)) == ids_of(text)
