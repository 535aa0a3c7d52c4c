"""Packing of token sequences into windows by the sum of squares rule.

Each task packs the documents of its own part of the input while it reads them, so nothing is shuffled. A document's
ids (and an end id) go into the window whose fill level makes the sum over all levels of the squared number of
partly filled windows the least. The level array holds that number for each level; a
document of size s that goes from level h to h + s changes the sum by 2 * (n[h + s] - n[h]) + 2, one
that fills its window by 1 - 2 * n[h], and a new window by 2 * n[s] + 1. Equal changes: the fullest window.

Documents are cut in three cases only. What exceeds a window is cut into full windows first. A task keeps at most
``most_open`` windows open; where a further one would be opened, a document may also be cut to fill the window of a level,
which changes the sum by 1 - 2 * n[h], and its rest is placed anew. When the input of a task ends, windows whose
fill is a power of two stay as they are, as they need no padding; the emptiest others are cut up to fill the fullest, and the
last one is cut into powers of two. So no window needs padding, whatever the sizes are, and a task's end
makes at most twelve short windows and one cut for each window that is open then.

Cases: a null text is an empty one (the end id alone). Null doc_ids and rows that repeat are packed like others. Texts of
any length are encoded whole, a stretch at a time. An empty table gives no windows. Other columns are ignored, whatever their names are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_quality import blocks
from .shared import documents, materialize
from .token_files import STRETCH, default_tokenizer, encoder_of

CAPACITY = 4096
#: Words in the younger half of the encoder's cache: nothing else here takes much memory.
KEPT_WORDS = 500_000
#: Bits of a sequence_id below the number of the task that made it.
TASK_BITS = 33

#: A piece: doc_id, the place of its first id in its document, its ids, and how many ids the document has.
Piece = tuple[int | None, int, np.ndarray, int]


class SumOfSquares:
    """Windows of at most ``capacity`` ids that are filled online; ``add`` and ``settle`` return those that are done."""

    def __init__(self, capacity: int = CAPACITY, most_open: int = 1024):
        if capacity < 2 or most_open < 1:
            raise ValueError("windows hold two ids or more, and one of them at least must be open")
        self.capacity, self.most_open = capacity, most_open
        #: How many windows are open at each level; empty and full ones don't count.
        self.levels = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0

    def place(self, size: int) -> tuple[int, int]:
        """The level whose window takes up to ``size`` ids, 0 for a new window, and how many ids it takes."""
        held = np.flatnonzero(self.levels)
        room = self.capacity - held
        fits = held[room >= size]
        change = 2 * (self.levels[fits + size] - self.levels[fits]) + 2 - (fits + size == self.capacity)
        best, least = (int(fits[::-1][change[::-1].argmin()]), int(change.min())) if len(fits) else (0, 0)
        fresh = 2 * int(self.levels[size]) + (size < self.capacity)
        if self.n_open < self.most_open or size == self.capacity:
            return (best, size) if len(fits) and least <= fresh else (0, size)
        cut = held[room < size]
        if len(cut):
            crowd = self.levels[cut]
            level = int(cut[::-1][crowd[::-1].argmax()])
            if not len(fits) or 1 - 2 * int(crowd.max()) < least:
                return level, self.capacity - level
        return best, size

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[list[Piece]]:
        """Places a document; returns the windows that it fills."""
        done, at, total = [], 0, len(ids)
        while at < total:
            level, size = self.place(min(self.capacity, total - at))
            window: list[Piece] = []
            if level:
                window = self.windows[level].pop()
                self.levels[level] -= 1
                self.n_open -= 1
            # A piece of a long document doesn't keep the whole of it in memory.
            window.append((doc_id, at, ids if size == total else ids[at : at + size].copy(), total))
            at, level = at + size, level + size
            if level == self.capacity:
                done.append(window)
            else:
                self.windows[level].append(window)
                self.levels[level] += 1
                self.n_open += 1
        return done

    def settle(self) -> list[list[Piece]]:
        """Closes all open windows so that each is full or has a power of two of ids."""
        done: list[list[Piece]] = []
        left: list[tuple[int, list[Piece]]] = []
        for level in np.flatnonzero(self.levels).tolist()[::-1]:
            if level & (level - 1) == 0:
                done += self.windows[level]
            else:
                left += [(level, window) for window in self.windows[level]]
            self.windows[level] = []
        self.levels[:] = 0
        self.n_open = 0
        first, last = 0, len(left) - 1
        fill = left[0][0] if left else 0
        while first < last:
            window, source = left[first][1], left[last][1]
            if room := self.capacity - fill:
                if not source:
                    last -= 1
                    continue
                doc_id, start, ids, total = source.pop()
                if len(ids) > room:
                    source.append((doc_id, start, ids[:-room], total))
                    start, ids = start + len(ids) - room, ids[-room:]
                window.append((doc_id, start, ids, total))
                fill += len(ids)
                continue
            done.append(window)
            first += 1
            fill = sum(len(p[2]) for p in left[first][1])
        if left and fill:
            done += _powers(left[first][1], fill)
        return done


def _powers(window: list[Piece], fill: int) -> list[list[Piece]]:
    """The pieces of one window in windows of descending powers of two."""
    done, pieces = [], window[::-1]
    while fill:
        room = 1 << (fill.bit_length() - 1)
        fill -= room
        part: list[Piece] = []
        while room:
            doc_id, start, ids, total = pieces.pop()
            if len(ids) > room:
                pieces.append((doc_id, start + room, ids[room:], total))
                ids = ids[:room]
            part.append((doc_id, start, ids, total))
            room -= len(ids)
        done.append(part)
    return done


def padded(fill: int, capacity: int = CAPACITY) -> int:
    """Ids that a window of ``fill`` ids takes up: a power of two needs no padding."""
    return fill if fill & (fill - 1) == 0 else capacity


PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64()), ("doc_tokens", pa.int64())])
WINDOWS = "sequence_id long, fill int, size int, width int, ids binary, pieces array<struct<doc_id: long, start: long, length: long, offset: long, doc_tokens: long>>"
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(PIECE)]
_NAMES = ["sequence_id", "fill", "size", "width", "ids", "pieces"]


def _batch(windows: list[list[Piece]], first: int, capacity: int) -> pa.RecordBatch:
    rows = []
    for nth, window in enumerate(windows, first):
        at, pieces = 0, []
        for doc_id, start, ids, total in window:
            pieces.append({"doc_id": doc_id, "start": start, "length": len(ids), "offset": at, "doc_tokens": total})
            at += len(ids)
        rows.append((nth, at, padded(at, capacity), window[0][2].itemsize, b"".join(p[2].tobytes() for p in window), pieces))
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def pack_documents(df: DataFrame, tokenizer: str, *, end_id: int = 2, capacity: int = CAPACITY, most_open: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Windows: sequence_id, fill, size (with padding), width (bytes an id), ids (little-endian), pieces in their order in the window.

    A sequence_id is the number of the task, then that of the window in it; they don't repeat.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, nth, done = SumOfSquares(capacity, most_open), TaskContext.get().partitionId() << TASK_BITS, []
        for rows, texts in blocks(batches, STRETCH):
            encoder = encoder_of(tokenizer, KEPT_WORDS)
            end = np.array([end_id], encoder.dtype).tobytes()
            for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.encode_all(texts), strict=True):
                done += packer.add(doc_id, np.frombuffer(ids + end, encoder.dtype))
                if len(done) >= 256:
                    yield _batch(done, nth, capacity)
                    nth, done = nth + len(done), []
        done += packer.settle()
        if done:
            yield _batch(done, nth, capacity)

    texts = df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return texts.mapInArrow(pack, WINDOWS)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, size int"


def pieces_of(windows: DataFrame) -> DataFrame:
    """One row per piece of the windows, with the crc32 of its ids as 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, pieces = batch.column(3).to_pylist(), batch.column(5)
            parent = np.repeat(np.arange(batch.num_rows), np.diff(pieces.offsets.to_numpy()))
            flat = pieces.flatten()
            doc_id, start, length, offset, total = (flat.field(i) for i in range(5))
            raw = [memoryview(np.frombuffer(ids, f"<u{w}").astype("<u4")).cast("B") for ids, w in zip(batch.column(4).to_pylist(), width, strict=True)]
            crc = [zlib.crc32(raw[w][4 * a : 4 * (a + n)]) for w, a, n in zip(parent.tolist(), offset.to_pylist(), length.to_pylist(), strict=True)]
            of = pa.array(parent)
            yield pa.RecordBatch.from_arrays([doc_id, start, length, pa.array(crc, pa.int64()), total, batch.column(0).take(of), offset, batch.column(2).take(of)], [x.split()[0] for x in PIECES.split(", ")])

    return windows.mapInArrow(read, PIECES)


def op12_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows, _ = materialize(pack_documents(documents(spark, sf_dir), default_tokenizer()), "packed")
    return pieces_of(windows)
