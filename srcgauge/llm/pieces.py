"""Exact merge-type encoding from a table of each prefix's last token, and decoding.

The encoding of a text by merges is the one split into vocabulary tokens in which
every two neighbours are *compatible*: merging their joined text gives these two
tokens again. So each prefix of a text has one last token, found from the tokens
that end there (matches of an automaton over the vocabulary): the one that starts
the text or is compatible with the last token of the prefix before it. Ids are
recovered backwards from the end.

No token reaches over a space mark that begins a word, a line break or another
character outside the vocabulary, so a text's ids are its segments' ids one after
another, and a worker remembers those of frequent segments.

In a run of space marks the last token of each prefix grows to the left while it and
the token before it join to a token: pieces of space marks all rank alike and last, so
the leftmost pair merges first, and a word takes the mark before it beforehand.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgauge.llm.common import slices, small_batches, texts_of

SPACE = "▁"
#: Digits that count as letters in patterns.
RAISED = "²³¹¼½¾"
LETTERS = rf"[^\W\d_{RAISED}]+"
#: A segment: space marks and what follows up to the next mark or line break.
WORDS = f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n"
#: The same, cut between letters and other characters too, for vocabularies in
#: which no token holds both.
LETTER_RUNS = rf"{SPACE}*(?:{LETTERS}|(?:[^\w{SPACE}\n]|[\d_{RAISED}])+)|{SPACE}+|\n"
#: Distinct segments, of so many letters at most, and token pairs that a worker remembers.
KNOWN_SEGMENTS = 300_000
KNOWN_LENGTH = 64
KNOWN_PAIRS = 600_000


class MergeVocabulary:
    """The pieces of a merge-type model: id, merge order and the byte ids."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece: list[str] = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.order: dict[str, tuple[float, int]] = {}
        for i, piece in enumerate(self.piece):
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value], self.byte_of[i] = i, value
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.order[piece] = (-model.get_score(i), i)
        self.id = {piece: i for piece, (_, i) in self.order.items()}
        self.letters = {c for piece in self.order for c in piece}
        #: The two parts that the last merge of a token joins; only tokens that
        #: merging reaches are kept.
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.order:
            if len(piece) == 1:
                self.automaton.add_word(piece, piece)
            elif len(halves := self.merged(piece, 2)) == 2:
                self.halves[piece] = halves[0], halves[1]
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self._pairs: dict[tuple[str, str], bool] = {}
        marks = {p: r for p, (r, _) in self.order.items() if not p.strip(SPACE)}
        #: Lengths of the tokens of space marks, if these rank alike and after all others
        #: and no other token holds a mark but as its first letter.
        self.mark_lengths = {len(p) for p in marks}
        if len(set(marks.values())) > 1 or any(
            r >= marks.get(SPACE, r) or SPACE in p[1:]
            for p, (r, _) in self.order.items()
            if p not in marks
        ):
            self.mark_lengths = set()
        letter = re.compile(LETTERS).fullmatch
        mixed = any(
            SPACE not in piece[i : i + 2]
            and "\n" not in piece
            and (not letter(piece[i])) != (not letter(piece[i + 1]))
            for piece in self.order
            for i in range(len(piece) - 1)
        )
        self.segment = re.compile(WORDS if mixed else LETTER_RUNS)

    def segments(self, text: str) -> list[str]:
        """Cut a text, with a space mark before it, where no token can reach over."""
        return self.segment.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def merged(self, text: str, least: int = 1) -> list[str]:
        """The merges done one by one, the best-ranked pair first and the leftmost of
        equals, until ``least`` parts are left. Pairs wait in a heap; one whose parts have
        merged with others since is passed over."""
        parts, rank, n = list(text), self.order, len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting: list[tuple[float, int, str]] = []

        def pair(i: int, j: int) -> str | None:
            joined = parts[i] + parts[j]
            return joined if joined in rank else None

        for i in range(n - 1):
            if joined := pair(i, i + 1):
                waiting.append((rank[joined][0], i, joined))
        heapify(waiting)
        left = n
        while waiting and left > least:
            _, i, joined = heappop(waiting)
            j = after[i]
            if not parts[i] or j == n or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = j = after[j]
            left -= 1
            if j < n:
                before[j] = i
                if joined := pair(i, j):
                    heappush(waiting, (rank[joined][0], i, joined))
            if (h := before[i]) >= 0 and (joined := pair(h, i)):
                heappush(waiting, (rank[joined][0], h, joined))
        return [p for p in parts if p]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joined text gives these two tokens.

        Both tokens are unmerged, the latest merge first. They fail if the parts
        that meet at their border could have merged before one of them was used.
        """
        key = (left, right)
        found = self._pairs.get(key)
        if found is not None:
            return found
        order, halves = self.order, self.halves
        used, used_left = float("inf"), True
        found = True
        while True:
            across = order.get(left + right)
            if across is not None and (
                across[0] < used or across[0] == used and not used_left
            ):
                found = False
                break
            a = order[left][0] if left in halves else float("-inf")
            b = order[right][0] if right in halves else float("-inf")
            if a == b == float("-inf"):
                break
            if a > b:
                used, used_left, left = a, True, halves[left][1]
            else:
                used, used_left, right = b, False, halves[right][0]
        if len(self._pairs) > KNOWN_PAIRS:
            self._pairs.clear()
        self._pairs[key] = found
        return found

    def tokens(self, run: str) -> list[str]:
        """Tokens of a run of known letters without two space marks in a row."""
        last: list[str] = [""] * (len(run) + 1)
        for end, token in self.automaton.iter(run):
            start = end + 1 - len(token)
            before = last[start]
            if not last[end + 1] and (
                not start or (before and self.compatible(before, token))
            ):
                last[end + 1] = token
        out, at = [], len(run)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def segment_ids(self, segment: str) -> list[int]:
        """Ids of a segment; letters outside the vocabulary become their bytes."""
        ids: list[int] = []
        run = 0
        for i, c in enumerate(segment):
            if c not in self.letters:
                ids += self._run_ids(segment[run:i])
                ids += [self.bytes[b] for b in c.encode()]
                run = i + 1
        return ids + self._run_ids(segment[run:])

    def mark_tokens(self, n: int) -> list[str]:
        """Tokens of a run of space marks."""
        last, lengths = [0] * (n + 1), self.mark_lengths
        for end in range(1, n + 1):
            size = 1
            while (before := last[end - size]) and before + size in lengths:
                size += before
            last[end] = size
        out = []
        while n:
            out.append(SPACE * last[n])
            n -= last[n]
        return out[::-1]

    def _run_ids(self, run: str) -> list[int]:
        if not run.startswith(SPACE + SPACE):
            parts = self.tokens(run)
        elif self.mark_lengths:
            word = run.lstrip(SPACE)
            marks = len(run) - len(word)
            parts = self.tokens(SPACE + word) if word else [SPACE]
            parts = self.mark_tokens(marks - (parts[0] != SPACE)) + parts[parts[0] == SPACE :]
        else:
            parts = self.merged(run)
        return [self.id[p] for p in parts]

    def text_of(self, ids: list[int]) -> str:
        """The text of ids with spaces for marks; wrong bytes become U+FFFD."""
        out, held = [], bytearray()
        for i in ids:
            value = self.byte_of.get(i)
            if value is not None:
                held.append(value)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.piece[i])
        out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")


class Segments(dict):
    """What is remembered of a segment: (number of ids, ids as text, decoded text).

    Long segments are not remembered. Two generations: when the young one is full it becomes the old one, and what
    is asked for again comes back from there.
    """

    def __init__(self, vocabulary: MergeVocabulary):
        self.vocabulary = vocabulary
        self.old: dict[str, tuple[int, str, str]] = {}

    def __missing__(self, segment: str) -> tuple[int, str, str]:
        if len(self) > KNOWN_SEGMENTS:
            self.old = dict(self)
            self.clear()
        found = self.old.get(segment)
        if found is None:
            ids = self.vocabulary.segment_ids(segment)
            found = len(ids), ",".join(map(str, ids)), self.vocabulary.text_of(ids)
        if len(segment) <= KNOWN_LENGTH:
            self[segment] = found
        return found


@lru_cache(2)
def vocabulary(path: str) -> MergeVocabulary:
    return MergeVocabulary(path)


@lru_cache(2)
def known_segments(path: str) -> Segments:
    return Segments(vocabulary(path))


def encode(text: str, path: str) -> list[int]:
    """Ids of a text."""
    vocab = vocabulary(path)
    return [i for s in vocab.segments(text) for i in vocab.segment_ids(s)]


def decode(ids: list[int], path: str) -> str:
    """The text of ids, without the mark set before it."""
    return vocabulary(path).text_of(ids).removeprefix(" ")


CODED = "n_tokens long, ids string, decoded string"


def _code(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_segments(path)
        get, segments = known.__getitem__, known.vocabulary.segments
        for batch in slices(batches, "text"):
            counts, ids, back = [], [], []
            for text in texts_of(batch, "text"):
                found = list(map(get, segments(text)))
                counts.append(sum(n for n, _, _ in found))
                ids.append(",".join([i for _, i, _ in found]))
                back.append("".join([d for _, _, d in found]).removeprefix(" "))
            if digest:
                ids = [hashlib.sha256(x.encode()).hexdigest() for x in ids]
                back = [hashlib.sha256(x.encode()).hexdigest() for x in back]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids": pa.array(ids, pa.string()),
                    "decoded": pa.array(back, pa.string()),
                }
            )

    return run


def encode_decode(
    docs: DataFrame,
    model: str,
    digest: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (decimal, joined by commas) and the decoded text.

    With ``digest`` the last two are their SHA-256 in hex, so that long texts do
    not leave the task. A null or empty text has no ids and decodes to ''. Rows are
    independent: repeated rows and null ids stay as they are, an empty table gives
    no rows, other columns are ignored. One narrow pass, no shuffle.
    """
    docs = small_batches(docs)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_code(model, digest), f"doc_id long, {CODED}")
