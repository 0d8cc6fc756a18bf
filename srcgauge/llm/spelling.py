"""Spelling variants by permuterm rotations.

Every word gets a terminator and all its rotations. Where two words differ by one replaced
character, the rotations that end with that character share all that stands before it;
where one word has one character more, its rotation that ends with this character starts
with a whole rotation of the other. So a rotation gives its prefix that skips the edited,
last character, and a whole rotation gives itself: words are near exactly if they give
one key in common. The keys are sorted by range over the cluster and scanned in groups of
equal keys. In such a group all words are near one another, and it holds at most one word
for each letter and one more, so no group can be hot.

A word that repeats a letter gives the same shorter word at each place of the run; only the
last one counts as an inserted letter, so that each near word is counted once.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcgauge.llm.common import numbered, slices, small_batches, stored

#: Letters are a to z and U+00C0 to U+00FF; A to Z are lower-cased.
_LOWER = bytes(range(256)).lower()
LETTERS = bytes(
    _LOWER[b] if 0x61 <= _LOWER[b] <= 0x7A or b >= 0xC0 else 0x20 for b in range(256)
)
#: Every so many-th hash of a run, on average, loses one code point.
LOSS = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form occurs at least so many times as often as its word.
FORM_RATIO = 5
MARK = b"$"
#: Keys longer than this are written as a hash of their two parts, so that a word of any
#: length gives keys of bounded size in time that follows its length.
KEY_BYTES = 64
#: Different words that a task adds up before it passes them on, and bytes read together.
HELD_WORDS = 200_000
WINDOW = 1 << 20
_PRIME = (1 << 61) - 1
_BASES = (0x1F3D5B79A8642CE1, 0x0B5AD4ECEDA1CE2A)


def run_counts(text: str) -> Counter[bytes]:
    """Lower-cased runs of at least six letters, as Latin-1, with their counts."""
    data = text.encode("latin-1", "replace").translate(LETTERS)
    counts: Counter[bytes] = Counter()
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + WINDOW)
        stop = len(data) if stop < 0 else stop
        counts.update(w for w in data[start:stop].split() if len(w) >= LEAST_LENGTH)
        start = stop
    return counts


def changed(prefix: int, run: bytes) -> bytes:
    """The run, or what is left where its hash with the document's id says so.

    ``prefix`` is the crc32 of the id and a colon.
    """
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % LOSS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of all documents, before any limit on n."""
    fields = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def flushed(held: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        batch = pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], schema=fields)
        held.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                text = text.as_py()
                if not text:
                    continue
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found, times in run_counts(text).items():
                    word = changed(prefix, found)
                    if len(word) >= LEAST_LENGTH:
                        held[word] += times
                if len(held) >= HELD_WORDS:
                    yield flushed(held)
        if held:
            yield flushed(held)

    parts = small_batches(docs.select("doc_id", "text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _hashes(word: bytes, base: int) -> tuple[list[int], list[int]]:
    """Polynomial hashes of all prefixes, and the base's powers."""
    sums, powers = [0], [1]
    for b in word:
        sums.append((sums[-1] * base + b + 1) % _PRIME)
        powers.append(powers[-1] * base % _PRIME)
    return sums, powers


def rotation_keys(word: bytes) -> Iterator[tuple[bytes, int]]:
    """(key, kind) of a word: 0 a whole rotation, 1 and 2 one that skips its last character,
    2 where the next character is the same one."""
    n = len(word)
    tables = [_hashes(word, base) for base in _BASES] if n >= KEY_BYTES else None

    def key(end: int, start: int) -> bytes:  # word[start:], the mark, word[:end]
        if n - start + 1 + end <= KEY_BYTES:
            return word[start:] + MARK + word[:end]
        parts = [(s[end], (s[n] - s[start] * p[n - start]) % _PRIME) for s, p in tables]
        return struct.pack(">BQQQQQQ", 0, end, n - start, *parts[0], *parts[1])

    for i in range(n + 1):
        yield key(i, i), 0
    for i in range(n):
        yield key(i, i + 1), 2 if word[i : i + 1] == word[i + 1 : i + 2] else 1


def _rotations(words: DataFrame) -> DataFrame:
    """(key, wid, n, kind) of all rotations."""
    schema = "key binary, wid long, n long, kind int"
    fields = pa.schema([("key", pa.binary()), ("wid", pa.int64()), ("n", pa.int64()), ("kind", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for wid, word, n in zip(*(batch.column(c).to_pylist() for c in ("wid", "word", "n"))):
                for key, kind in rotation_keys(word.encode("latin-1")):
                    rows.append((key, wid, n, kind))
                    if len(rows) == 50_000:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), fields.types)), schema=fields)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), fields.types)), schema=fields)

    return small_batches(words.select("wid", "word", "n")).mapInArrow(run, schema)


def near_words(words: DataFrame) -> DataFrame:
    """(wid, n_near, best_n, best) of the words (wid, word, n) that have near words.

    ``wid`` follows code-point order; the best near word has the largest n, of equals the
    smallest wid. Words have letters as here, code points up to U+00FF.
    """
    keyed = _rotations(words).repartitionByRange("key")
    group = Window.partitionBy("key")
    order = group.orderBy(F.desc("n"), "wid")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct("n", (-F.col("wid")).alias("w"))
    scanned = keyed.select(
        "wid", "kind",
        F.count("*").over(group).alias("size"),
        F.count_if(F.col("kind") == 0).over(group).alias("full"),
        F.count_if(F.col("kind") == 1).over(group).alias("longer"),
        F.first(member).over(whole).alias("best"), F.nth_value(member, 2).over(whole).alias("next"),
    ).filter("size > 1")
    skips = F.col("size") - F.col("full") - 1
    near = (
        F.when(F.col("kind") == 0, F.col("longer"))
        .when(F.col("kind") == 1, skips + F.col("full")).otherwise(skips)
    )
    best = F.when(F.col("best.w") == -F.col("wid"), F.col("next")).otherwise(F.col("best"))
    per_word = scanned.select("wid", near.alias("near"), best.alias("best")).groupBy("wid")
    return per_word.agg(F.sum("near").alias("n_near"), F.max("best").alias("best")).select(
        "wid", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.w")).alias("best")
    )


def _roots(links: DataFrame, rounds: int) -> DataFrame:
    """(wid, to) with ``to`` the end of the chain of links; each round doubles the steps."""
    links = stored(links, "spelling-links")
    for _ in range(rounds):
        further = links.select(F.col("wid").alias("to"), F.col("to").alias("_next"))
        links = stored(
            links.join(further, "to", "left").select("wid", F.coalesce("_next", "to").alias("to")),
            "spelling-links",
        )
    return links


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of ``docs`` (doc_id, text) with the more frequent word each is a variant of.

    Returns word, form, root, n, n_near, form_n for every word of at least six letters
    that occurs at least five times. A form is the near word of largest n, ties going to
    the first in code-point order, if that n is at least five times the word's; root
    follows forms to the last, and is the word itself without a form.

    A null or empty text has no words; a null doc_id is hashed as an empty one. Repeated
    rows count each. An empty table gives an empty result. Other columns are ignored.

    Forms are at least five times as frequent as their words, so a chain of forms has at
    most log5(largest n) links, which bounds the rounds that find the roots.
    """
    words = numbered(count_words(docs).filter(F.col("n") >= LEAST_COUNT), "wid", "word")
    words = stored(words, "spelling-words")
    near = stored(near_words(words), "spelling-near")
    found = words.join(near, "wid", "left").withColumn(
        "to", F.when(F.col("best_n") >= FORM_RATIO * F.col("n"), F.col("best"))
    )
    most = words.agg(F.max("n")).first()[0] or 0
    steps = 0
    while LEAST_COUNT * FORM_RATIO ** (steps + 1) <= most:
        steps += 1
    roots = _roots(found.filter("to is not null").select("wid", "to"), max(0, steps - 1).bit_length())
    named = lambda key, name: words.select(F.col("wid").alias(key), F.col("word").alias(name))
    found = found.join(roots.withColumnRenamed("to", "_end"), "wid", "left")
    found = found.join(named("to", "form"), "to", "left").join(named("_end", "_root"), "_end", "left")
    return found.select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("to").isNotNull(), F.col("best_n")).alias("form_n"),
    )
