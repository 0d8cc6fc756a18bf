"""Best-fit packing of token sequences by hierarchical residual packing.

1. Each task packs the pieces of its split by best-fit decreasing, in groups of a
   bounded number of pieces, and emits the bins.
2. Of a group only a few bins are carried on: those at most half full (best fit
   leaves one at most) and the ``FAN_IN`` bins with the largest gaps. All others
   are final.
3. Carried bins of ``FAN_IN`` groups meet in a parent group and are packed as items
   by best fit again, round by round, until one group is left.

What is carried loses no merge: two bins over half full never fit together, so a
merge needs a bin at most half full; a parent group has at most one of these from
each of its ``FAN_IN`` children, and each needs one gap, for which the largest
``FAN_IN`` gaps of each child always suffice. Hence a group of any round holds at
most ``FAN_IN * (FAN_IN + 1)`` bins, at any input size.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgauge.llm.common import slices, small_batches, stored, texts_of

FAN_IN = 16
#: Pieces that a task packs together.
GROUP_PIECES = 1 << 16
#: Chunks of a generation that a worker remembers.
KNOWN_WORDS = 200_000
#: Text that white space splits another way in the tokenizer than in Python.
CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")


#: Words as the vocabulary's pattern cuts a chunk without an apostrophe.
PARTS = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable
    Latin-1 as it is, the others from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class WordIds(dict):
    """Ids of a chunk between white space as little-endian bytes.

    The tokenizer of this vocabulary drops white space and never joins across
    it, so a text's ids are its chunks' ids one after another. Chunks are
    remembered in two generations: when the young one is full it becomes the old
    one. An unknown chunk of plain words goes to the tokenizer's merges word by
    word; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > KNOWN_WORDS:
            self.old = dict(self)
            self.clear()
        found = self.old.get(chunk)
        if found is None:
            ids = self.word_by_word(chunk)
            if ids is None:
                ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        self[chunk] = found
        return found

    def word_by_word(self, chunk: str) -> list[int] | None:
        """Ids of a chunk whose words are plain: letters, or ASCII. None: not plain."""
        if "'" in chunk or "<|" in chunk or not chunk.isprintable():
            return None
        if not chunk.isascii() and (
            not unicodedata.is_normalized("NFC", chunk) or "İ" in chunk or "Σ" in chunk
        ):
            return None
        ids = []
        for word in PARTS.findall(chunk.lower()):
            if not word.isascii():
                if not word.isalpha():
                    return None
                word = "".join([self.letters[b] for b in word.encode()])
            ids += [t.id for t in self.merges(word)]
        return ids

    def of(self, text: str) -> bytes:
        if any(c in text for c in CONTROLS):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset in the bin) of each item."""
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g is set while a bin with gap g is open
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = gaps >> size
        if fits:
            gap = (fits & -fits).bit_length() - 1 + size
            bin_ = open_bins[gap].pop()
            if not open_bins[gap]:
                gaps ^= 1 << gap
        else:
            gap, bin_ = capacity, made
            made += 1
        bins[i], offsets[i] = bin_, capacity - gap
        if gap > size:
            open_bins[gap - size].append(bin_)
            gaps |= 1 << (gap - size)
    return bins, offsets


def carried_bins(fill: np.ndarray, capacity: int) -> np.ndarray:
    """Which bins of a group go to the next round."""
    open_ = fill < capacity
    carried = open_ & (2 * fill <= capacity)
    gaps = np.argsort(fill + (capacity + 1) * ~open_, kind="stable")[:FAN_IN]
    carried[gaps] |= open_[gaps]
    return carried


PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long,"
    " bin long, offset long, fill int, carried boolean"
)


def _pack_splits(path: str, capacity: int, id_type: pa.DataType, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        end = struct.pack("<I", end_id)
        first = TaskContext.get().partitionId() << 32
        made = 0
        docs: list = []
        rows: list[tuple[int, int, int, int]] = []

        def packed() -> pa.RecordBatch:
            nonlocal first
            piece, start, length, crc = np.array(rows, np.int64).T
            bins, offsets = best_fit(length, capacity)
            fill = np.bincount(bins, weights=length).astype(np.int64)
            out = {
                "doc_id": pa.array(docs, id_type),
                "piece": pa.array(piece.astype(np.int32)),
                "start": start,
                "length": length,
                "ids_crc32": crc,
                "bin": first + bins,
                "offset": offsets,
                "fill": fill[bins].astype(np.int32),
                "carried": carried_bins(fill, capacity)[bins],
            }
            first += GROUP_PIECES
            docs.clear()
            rows.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in slices(batches, "text"):
            for doc_id, text in zip(
                batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True
            ):
                ids = known.of(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    docs.append(doc_id)
                    rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    made += 1
                    if len(rows) == GROUP_PIECES:
                        yield packed()
        if rows:
            yield packed()

    return run


def _merge_bins(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", ignore_index=True)
        bins, offsets = best_fit(pdf["fill"].to_numpy(np.int64), capacity)
        fill = np.bincount(bins, weights=pdf["fill"]).astype(np.int64)
        names = np.full(len(fill), -1, np.int64)
        np.maximum.at(names, bins, pdf["bin"].to_numpy())  # a merged bin's own name
        carried = carried_bins(fill, capacity)
        members = [([], []) for _ in fill]
        for b, shift, inner, shifts in zip(
            bins, offsets, pdf["members"], pdf["shifts"], strict=True
        ):
            members[b][0].extend(inner)
            members[b][1].extend(s + shift for s in shifts)
        return pd.DataFrame(
            {
                "group": pdf["group"].iloc[0],
                "bin": names,
                "fill": fill.astype(np.int32),
                "carried": carried,
                "members": [m for m, _ in members],
                "shifts": [s for _, s in members],
            }
        )

    return run


BINS = "group long, bin long, fill int, carried boolean, members array<long>, shifts array<long>"


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    A document is its text's ids and then ``end_id``; a null or empty text is that
    id alone. Longer ones are cut into pieces of ``capacity`` ids. One row per
    piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated
    rows and null ids are packed like any other row; an empty table gives no rows;
    other columns of the input are ignored.

    The pieces are written once to the shared folder; only carried bins (a bounded
    number per group) are shuffled.
    """
    docs = small_batches(docs)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    split = _pack_splits(tokenizer, capacity, pa.int64(), end_id)
    pieces = stored(source.mapInArrow(split, PIECES), "pieces")

    carried = pieces.filter("carried")
    waiting = carried.groupBy("bin").agg(F.first("fill").alias("fill")).select(
        F.shiftright("bin", 32).alias("group"),  # the task that made it
        "bin",
        "fill",
        F.lit(True).alias("carried"),
        F.array("bin").alias("members"),
        F.array(F.lit(0).cast("long")).alias("shifts"),
    )
    last = waiting.agg(F.max("group")).first()[0]
    done = []
    step = 0  # the first round joins the groups of one task
    while last is not None:
        merged = stored(
            waiting.withColumn("group", F.shiftright("group", step))
            .groupBy("group")
            .applyInPandas(_merge_bins(capacity), BINS),
            "bins",
        )
        last, step = last >> step, 4
        if last == 0:
            done.append(merged)
            break
        done.append(merged.filter("not carried"))
        waiting = merged.filter("carried")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    result = pieces.filter("not carried").select(
        *columns, F.col("bin").alias("sequence_id"), "offset"
    )
    if not done:
        return result
    merged = done[0]
    for more in done[1:]:
        merged = merged.unionByName(more)
    moves = merged.select(
        F.col("bin").alias("sequence_id"), F.inline(F.arrays_zip("members", "shifts"))
    ).withColumnRenamed("members", "bin")
    moved = carried.join(moves, "bin").select(
        *columns, "sequence_id", (F.col("offset") + F.col("shifts")).alias("offset")
    )
    return result.unionByName(moved)
