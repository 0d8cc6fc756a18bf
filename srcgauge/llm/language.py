"""Language identification with interpolated Kneser-Ney character models.

One model of four-letter sequences per language. The models of all languages are
kept together: per order one sorted array of hashes of the sequences seen in any
language, and beside it each language's interpolated log probability. A text gets
the language with the lowest cross-entropy per letter; a cross-entropy that
texts of that language do not reach is rejected, by a limit calibrated on texts
the models were not made from.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgauge.llm.common import (
    mixed, remainder, slices, small_batches, stored, texts_of, with_columns,
)

ORDER = 4
#: Characters learned from per language (on average, by a hash of pieces of the texts).
LEARN_CHARS = 4_000_000
#: Characters learned from in all, divided over the languages.
ALL_CHARS = 32_000_000
#: Characters of a piece at most; a language's share is some 64 pieces or more.
PIECE = 16_384
#: One in so many of these pieces calibrates instead.
CALIBRATE = 5
UNKNOWN = "und"
#: Texts with fewer letters are not rejected for their cross-entropy.
JUDGED_LETTERS = 40
#: The accepted cross-entropy: so many times what one calibrating text in a thousand exceeds.
MARGIN = 1.4
GAP = 32
STEP_BYTES = 1 << 20
#: Numbers of a full table (sequences x languages); larger ones keep only what was seen.
FULL_NUMBERS = 16_000_000
#: Texts x languages, and numbers added up, at once.
STEP_NUMBERS = 4_000_000
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)


@lru_cache(1)
def letter_codes() -> np.ndarray:
    """Code of each code point: itself if a letter (0xFFFF beyond 16 bits), else a gap."""
    codes = np.full(0x110000, GAP, np.uint16)
    for c in range(0x110000):
        if chr(c).isalpha():
            codes[c] = min(c, 0xFFFF)
    return codes


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every four-letter sequence, packed in 64 bits, and how many each text has.

    Texts are lower-cased; a run of other characters is one gap; gaps surround a text.
    """
    points = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    pad = np.full(ORDER - 1, 0x20, np.uint32)
    parts, end = [], np.full(1, 0x20, np.uint32)
    for p in points:
        parts += [pad, p, end]
    codes = letter_codes()[np.concatenate(parts)] if parts else np.empty(0, np.uint16)
    text = np.repeat(np.arange(len(texts)), [len(p) + ORDER for p in points])
    gap = codes == GAP
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else []
    for i in range(ORDER - 1):
        keep[np.asarray(first, np.int64) + i] = True  # the gaps before a text
    # A text that starts with gaps has them once: drop those right after its own.
    codes, text = codes[keep], text[keep]
    wide = codes.astype(np.uint64)
    keys = wide[: max(0, len(wide) - ORDER + 1)]
    for i in range(1, ORDER):
        keys = (keys << np.uint64(16)) | wide[i : i + len(keys)]
    inside = text[: len(keys)] == text[ORDER - 1 :][: len(keys)]
    return keys[inside], np.bincount(text[: len(keys)][inside], minlength=len(texts))


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


@dataclass
class Table:
    """Rows of numbers by key: the keys' hashes in order, and a row for each."""

    hashes: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, rows: np.ndarray) -> Table:
        hashes = mixed(keys)
        order = np.argsort(hashes)
        return cls(hashes[order], rows[order].astype(np.float32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key; -1: not there."""
        if not len(self.hashes):
            return np.full(len(keys), -1)
        hashes = mixed(keys)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        at[self.hashes[at] != hashes] = -1
        return at


@dataclass
class SeenTable(Table):
    """Numbers by key and language, only where there are some. ``rows`` tells where a key's
    numbers begin, and at last their count."""

    languages: np.ndarray
    values: np.ndarray

    @classmethod
    def of_languages(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> SeenTable:
        """From each language's keys and numbers."""
        hashes = mixed(np.concatenate([k for k, _ in parts]))
        language = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        values = np.concatenate([v for _, v in parts]).astype(np.float32)
        return cls(hashes[first], np.append(first, len(hashes)), language[order], values[order])

    def add(self, keys: np.ndarray, text: np.ndarray, sums: np.ndarray) -> None:
        """Add the numbers of each text's keys to its row of ``sums``."""
        at = self.find(keys)
        hit = at >= 0
        pairs, times = np.unique(text[hit] * len(self.hashes) + at[hit], return_counts=True)
        texts, rows = pairs // len(self.hashes), pairs % len(self.hashes)
        size = self.rows[rows + 1] - self.rows[rows]
        ends, start, flat = np.cumsum(size), 0, sums.reshape(-1)
        while start < len(rows):
            most = STEP_NUMBERS + (ends[start - 1] if start else 0)
            some = slice(start, max(start + 1, int(np.searchsorted(ends, most, side="right"))))
            n = size[some]
            entry = np.arange(n.sum()) + np.repeat(self.rows[rows[some]] - (np.cumsum(n) - n), n)
            place = np.repeat(texts[some] * sums.shape[1], n) + self.languages[entry]
            weights = np.repeat(times[some], n) * self.values[entry]
            flat += np.bincount(place, weights=weights, minlength=len(flat))
            start = some.stop


@dataclass
class Models:
    languages: list[str]
    #: Per order (from 1): log probabilities of sequences.
    seen: list[Table]
    #: Per length of the letters before (from 1): log weight of the shorter context.
    weight: list[Table]
    #: Log probability of a letter that was never seen.
    never: np.ndarray
    #: Per language: largest cross-entropy that is accepted; sharpness of the score.
    limits: np.ndarray
    sharpness: float = 1.0

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Per sequence and language: log probability of its last letter."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        todo = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            some = keys[todo] & _mask(order) if order < 4 else keys[todo]
            at = self.seen[order - 1].find(some)
            hit = at >= 0
            out[todo[hit]] += self.seen[order - 1].rows[at[hit]]
            todo, some = todo[~hit], some[~hit]
            if not len(todo):
                return out
            if order > 1:
                table = self.weight[order - 2]
                at = table.find(some >> np.uint64(16))
                hit = at >= 0
                out[todo[hit]] += table.rows[at[hit]]
        out[todo] += self.never
        return out

    def sums(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per text, of so many sequences, and language: log probability."""
        logs = self.log_probabilities(keys)
        sums = np.zeros((len(sizes), len(self.languages)))
        some = np.flatnonzero(sizes)
        if len(some):
            starts = (np.cumsum(sizes) - sizes)[some]
            sums[some] = np.add.reduceat(logs.astype(np.float64), starts, axis=0)
        return sums

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the cross-entropy per letter; the number of letters."""
        keys, sizes = sequences(texts)
        sums = self.sums(keys, sizes)
        letters = (keys & _mask(1)) != GAP
        text = np.repeat(np.arange(len(texts)), sizes)
        count = np.bincount(text[letters], minlength=len(texts))
        return -sums / np.maximum(1, sizes)[:, None], count


@dataclass
class SeenModels(Models):
    """The same for many languages. A log probability is that of a letter never seen, and
    for each order the weight of the shorter context and, if the sequence was seen, what
    it adds to that; ``seen`` and ``weight`` hold these."""

    def sums(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        text = np.repeat(np.arange(len(sizes)), sizes)
        sums = sizes[:, None] * self.never.astype(np.float64)
        for order in range(1, ORDER + 1):
            some = keys & _mask(order) if order < 4 else keys
            self.seen[order - 1].add(some, text, sums)
            if order > 1:
                self.weight[order - 2].add(some >> np.uint64(16), text, sums)
        return sums


def _learn_seen(languages: list[str], counts: list[list[tuple[np.ndarray, np.ndarray]]]):
    """Models that hold only what each language has."""
    base = 1 / (len(np.unique(np.concatenate([k for k, _ in counts[0]]))) + 1)
    seen, weight = [[] for _ in range(ORDER)], [[] for _ in range(ORDER)]
    never = np.zeros(len(languages))
    for i in range(len(languages)):
        shorter, below = None, None
        for order in range(1, ORDER + 1):
            own, n = counts[order - 1][i]
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
            contexts, context = np.unique(own >> np.uint64(16), return_inverse=True)
            total = np.bincount(context, weights=n)
            back = discount * np.bincount(context) / total
            if order == 1:
                lower = np.full(len(own), base)
                never[i] = np.log(back[0] * base)
            else:
                lower = below[np.searchsorted(shorter, own & _mask(order - 1))]
            p = (n - discount) / total[context] + back[context] * lower
            seen[order - 1].append((own, np.log(p) - np.log(back[context] * lower)))
            weight[order - 1].append((contexts, np.log(back)))
            shorter, below = own, p
    return SeenModels(
        languages, [SeenTable.of_languages(x) for x in seen],
        [SeenTable.of_languages(x) for x in weight[1:]], never.astype(np.float32),
        np.full(len(languages), np.inf),
    )


def learn(counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Interpolated Kneser-Ney models from each language's sequences and counts."""
    languages = sorted(counted)
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for language in languages:
        keys, n = counted[language]
        counts[ORDER - 1].append((keys, n))
        for order in range(ORDER - 1, 0, -1):  # in how many ways a sequence is continued leftwards
            keys, n = np.unique(keys & _mask(order), return_counts=True)
            counts[order - 1].append((keys, n))
    if len(np.unique(np.concatenate([k for k, _ in counts[-1]]))) * len(languages) > FULL_NUMBERS:
        return _learn_seen(languages, counts)
    letters = np.unique(np.concatenate([k for k, _ in counts[0]]))
    seen, weight = [], []
    below, never = None, None
    for order in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([k for k, _ in counts[order - 1]]))
        contexts = np.unique(keys >> np.uint64(16))
        p = np.zeros((len(keys), len(languages)))
        back = np.ones((len(contexts), len(languages)))
        for i, (own, n) in enumerate(counts[order - 1]):
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
            context = np.searchsorted(contexts, own >> np.uint64(16))
            total = np.bincount(context, weights=n, minlength=len(contexts))
            kinds = np.bincount(context, minlength=len(contexts))
            p[np.searchsorted(keys, own), i] = (n - discount) / total[context]
            there = total > 0
            back[there, i] = discount * kinds[there] / total[there]
        ahead = back[np.searchsorted(contexts, keys >> np.uint64(16))]
        if order == 1:
            base = 1 / (len(letters) + 1)
            p += ahead * base
            never = np.log(back[0] * base)
        else:
            shorter, rows = below
            p += ahead * rows[np.searchsorted(shorter, keys & _mask(order - 1))]
            weight.append(Table.of(contexts, np.log(back)))
        below = keys, p
        seen.append(Table.of(keys, np.log(p)))
    limits = np.full(len(languages), np.inf)
    return Models(languages, seen, weight, never.astype(np.float32), limits)


def _learn_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sequences and counts of the documents chosen for a language."""
    parts = []
    texts = pdf["text"].tolist()
    for i in range(0, len(texts), 200):
        parts.append(np.unique(sequences(texts[i : i + 200])[0], return_counts=True))
    keys = np.concatenate([k for k, _ in parts])
    keys, at = np.unique(keys, return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
    data = pickle.dumps((keys, n), protocol=5)
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "data": [data]})


def _steps(
    batches: Iterator[pa.RecordBatch], text: str, models: Models | None
) -> Iterator[pa.RecordBatch]:
    """Batches of some text and of few texts if there are many languages."""
    rows = max(1, STEP_NUMBERS // max(1, len(models.languages))) if models else STEP_NUMBERS
    for batch in slices(batches, text, STEP_BYTES):
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _counted(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    made = rows.groupBy("lang").applyInPandas(_learn_group, "lang string, data binary")
    counted = {r.lang: pickle.loads(r.data) for r in made.collect()}
    return {language: c for language, c in counted.items() if len(c[0])}


def train(docs: DataFrame, learn_from, learn_chars: int = LEARN_CHARS) -> Models | None:
    """Models of the languages in ``docs`` (doc_id, text, lang), from rows where
    ``learn_from`` holds.

    About ``learn_chars`` characters per language are used, in pieces chosen by a hash of
    the row and their place, and ``ALL_CHARS`` in all, so what reaches the driver is
    bounded: the counts of their sequences. Every language with a letter in its pieces is
    learned; one that has none left beside those that calibrate is learned from these
    and not calibrated.
    """
    docs = small_batches(docs).withColumn("pick", F.xxhash64("doc_id", "text"))
    usable = docs.filter(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = stored(usable.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")), "sizes")
    languages = sizes.count()
    if not languages:
        return None
    each = min(learn_chars, ALL_CHARS / languages)
    piece = int(min(PIECE, max(16, each // 64)))
    shares = sizes.select("lang", F.least(F.lit(1.0), each / F.greatest("chars", F.lit(1))).alias("share"))
    pieces = F.when(
        F.length("text") > piece, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{piece}}}"), F.lit(0))
    ).otherwise(F.array("text"))
    cut = usable.select("lang", "pick", F.posexplode(pieces).alias("k", "text")).withColumn(
        "pick", F.when(F.col("k") == 0, F.col("pick")).otherwise(F.xxhash64("pick", "k"))
    )
    held = F.pmod(F.shiftright("pick", 20), F.lit(CALIBRATE)) == 0
    chosen = stored(
        cut.join(F.broadcast(shares), "lang")  # a row a language
        .filter(F.pmod("pick", F.lit(1 << 20)) < F.col("share") * (1 << 20))
        .select("lang", "text", held.alias("held")),
        "languages",
    )
    counted = _counted(chosen.filter("not held"))
    calibrating = sorted(counted)
    if len(counted) < languages:
        known = docs.sparkSession.createDataFrame([(x,) for x in calibrating], "lang string")
        counted |= _counted(chosen.filter("held").join(F.broadcast(known), "lang", "left_anti"))
    if not counted:
        return None
    models = learn(counted)
    place = {language: i for i, language in enumerate(models.languages)}
    number = {language: place[language] for language in calibrating}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, "text", models):
            entropies, letters = models.cross_entropies(texts_of(batch, "text"))
            truth = np.array([number.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            some = (truth >= 0) & (letters > 0)
            entropies, letters, truth = entropies[some], letters[some], truth[some]
            own = entropies[np.arange(len(truth)), truth]
            judged = (letters >= JUDGED_LETTERS) & (entropies.argmin(axis=1) == truth)
            above = entropies - entropies.min(axis=1, keepdims=True, initial=np.inf)
            losses = []
            for sharpness in SHARPNESS:
                p = np.exp(-sharpness * above)
                p = p[np.arange(len(truth)), truth] / p.sum(axis=1)
                losses.append(-np.log(np.maximum(p, 1e-6)))
            yield pa.RecordBatch.from_pydict(
                {
                    "truth": pa.array(truth, pa.int32()),
                    "own": pa.array(np.where(judged, own, np.nan), pa.float64(), from_pandas=True),
                    "losses": pa.array(list(np.array(losses).T), pa.list_(pa.float64())),
                }
            )

    rows = (
        chosen.filter("held")
        .mapInArrow(measure, "truth int, own double, losses array<double>")
        .groupBy("truth")
        .agg(
            F.count("own").alias("judged"), F.percentile("own", 0.999).alias("own"),
            F.array(*[F.sum(F.col("losses")[i]) for i in range(len(SHARPNESS))]).alias("losses"),
        )
        .collect()  # a row a language
    )
    for r in rows:
        if r.judged >= 20:
            models.limits[r.truth] = MARGIN * r.own
    if rows:
        models.sharpness = SHARPNESS[int(np.sum([r.losses for r in rows], axis=0).argmin())]
    return models


PREDICTED = "lang_pred string, score double, cross_entropy double, rejected boolean"


def identify(
    docs: DataFrame, models: Models | None, text_col: str = "text", passed: tuple[str, ...] = ()
) -> DataFrame:
    """Per row the columns ``passed`` and lang_pred, score, cross_entropy, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    docs = small_batches(docs).select(*passed, F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in _steps(batches, "_text", known):
            texts = texts_of(batch, "_text")
            n = len(texts)
            names, score = np.full(n, UNKNOWN, object), np.zeros(n)
            own, rejected = np.full(n, np.nan), np.ones(n, bool)
            if known is not None:
                entropies, letters = known.cross_entropies(texts)
                best = entropies.argmin(axis=1)
                lowest = entropies[np.arange(n), best]
                odds = np.exp(-known.sharpness * (entropies - lowest[:, None])).sum(axis=1)
                some = letters > 0
                names[some] = np.array(known.languages, object)[best[some]]
                score[some], own[some] = 1 / odds[some], lowest[some]
                judged = letters >= JUDGED_LETTERS
                rejected = ~some | judged & (lowest > known.limits[best])
            found = [
                pa.array(names, pa.string()),
                pa.array(score),
                pa.array(own, from_pandas=True),
                pa.array(rejected),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passed), *found],
                [*passed, "lang_pred", "score", "cross_entropy", "rejected"],
            )

    schema = docs.select(*passed).schema
    return docs.mapInArrow(run, with_columns(schema, PREDICTED))


def language_id(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    held_fold: int = 2,
    learn_chars: int = LEARN_CHARS,
) -> DataFrame:
    """Learn from the documents outside the held fold and predict for all rows.

    Result: doc_id, held_out, lang_pred, score, cross_entropy, rejected. A text that
    is null or without a letter is ``und`` with score 0 and rejected; a text whose
    cross-entropy exceeds its language's limit keeps its prediction and is rejected.
    Rows with a null language or text are not learned from. Repeated rows count
    as often as they occur; a null id is in the fold of the empty text; with
    nothing to learn from every row is ``und``. Other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.col(lang_col).alias("lang"),
    )
    held = remainder("doc_id", folds) == held_fold
    models = train(rows, ~held, learn_chars)
    found = identify(rows, models, passed=("doc_id",))
    return found.select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )
