import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from srcgauge.llm import spelling
from srcgauge.llm.catalog import op11_permuterm_variants
from srcgauge.llm.common import numbered
from srcgauge.llm.spelling import near_words, rotation_keys, run_counts, spelling_variants
from tests.llm.conftest import SMALL

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    out, forms = {}, {}
    for w, n in words.items():
        others = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 5 * n else None
        out[w] = (n, len(others))
    rows = []
    for w, (n, n_near) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, n_near, words.get(forms[w])))
    return sorted(rows, key=lambda r: r[0])


def variants(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    return sorted(map(tuple, spelling_variants(df.repartition(3)).collect()), key=lambda r: r[0])


def test_query_against_brute_force(spark, documents):
    got = sorted(map(tuple, op11_permuterm_variants(spark, SMALL).collect()), key=lambda r: r[0])
    assert got == brute([(d["doc_id"], d["text"]) for d in documents])


def test_chains_repeated_letters_and_ties(spark):
    many = lambda word, n: f"{word} " * n
    rows = [(i, many(w, n)) for i, (w, n) in enumerate([
        ("aabbcc", 5), ("aaabbcc", 30), ("aaabbccc", 200), ("xaaabbccc", 1000), ("aabbccc", 6),
        ("aaaaaa", 5), ("aaaaaaa", 25), ("aaaaaaaa", 125), ("éaaaaa", 25), ("zaaaaa", 25),
        ("ÀÖ×÷ÿß", 7), ("ÀÖ×÷ÿ", 50), ("ÀÖ×÷ÿßa", 35), ("short", 900), ("fourth", 4),
    ])]
    got = variants(spark, rows)
    assert got == brute(rows)
    assert {r[0]: r[2] for r in got}["aabbcc"] == "xaaabbccc"


def test_random_words_against_brute_force(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abé"), rng.integers(6, 9))) for _ in range(150)]
    rows = [(int(i), f"{words[int(150 * u * u)]}, " * int(rng.integers(1, 60))) for i, u in enumerate(rng.random(300))]
    assert variants(spark, rows) == brute(rows)


def test_words_of_any_length(spark, monkeypatch):
    """Keys that are hashed meet the same partners, on both sides of the limit and far beyond it."""
    rng = np.random.default_rng(5)
    rows = []
    for n in (61, 62, 63, 64, 65, 66, 3000):
        word = "".join(rng.choice(list("ab"), n))
        at = int(rng.integers(0, n))
        made = [word, word[:at] + "c" + word[at + 1 :], word[:at] + "c" + word[at:], word[:at] + word[at + 1 :]]
        rows += [(len(rows) + i, f"{w} " * 6 * 6**i) for i, w in enumerate(made)]
    assert variants(spark, rows) == brute(rows)


def test_keys_are_bounded_in_size_and_number():
    keys = list(rotation_keys(b"ab" * 20_000))
    assert len(keys) == 80_001 and max(len(k) for k, _ in keys) <= spelling.KEY_BYTES
    assert len({k for k, _ in keys}) == len(keys)


def test_a_word_with_very_many_near_words(spark):
    """Every letter at every place: groups stay as small as the alphabet."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = sorted({"needle"[:i] + x + "needle"[i + 1 :] for i in range(6) for x in letters})
    df = spark.createDataFrame([(w, 9 if w != "needle" else 99) for w in made], "word string, n long")
    rows = {r.wid: r for r in near_words(numbered(df, "wid", "word")).collect()}
    centre = made.index("needle")
    assert rows[centre].n_near == len(made) - 1
    assert all(r.best == centre for w, r in rows.items() if w != centre)


def test_windows_and_other_characters(monkeypatch):
    text = "Größere, naïve—WÖRTER wörterĀwörter 日本語Straße" * 50
    want = Counter(r.translate(LOWER).encode("latin-1") for r in RUN.findall(text) if len(r) >= 6)
    assert run_counts(text) == want
    monkeypatch.setattr(spelling, "WINDOW", 5)
    assert run_counts(text) == want


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "nobody " * 5), (1, None), (1, ""), (2, "repeat"), *[(2, "repeat")] * 4, (3, "- 7 é")]
    assert variants(spark, rows) == brute(rows)
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = [(1, "longish word " * 200_000)]
    assert variants(spark, long) == brute(long)
