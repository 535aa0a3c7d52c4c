"""Token-id files with Elias-Fano document boundaries.

A shard file holds the ids of consecutive documents, one after another, as 16-bit
little-endian integers (32-bit where the vocabulary needs it), then two Elias-Fano
sequences: where each document ends, and which document it is. An Elias-Fano
sequence of n values up to u takes n * (2 + log2(u / n)) bits, and a select
structure (the position of every 256th one) finds any value without a table of
64-bit offsets. The footer names the sections::

    ids | ends: low, high, samples | doc ids: low, high, samples | footer JSON | its length (4 bytes) | magic

Documents stand in ascending doc_id order over all shards: the rows are dealt by
ranges of doc_id, and each task streams its sorted range into files.

Cases: a null text is an empty document (its end id alone). Null doc_ids come
first. Rows with the same doc_id stay apart, ordered by text. An empty table gives
no shards and no rows. Texts of any length are encoded whole, a stretch at a time.
Reading goes through the select samples, some thousands of documents at a time; no table of all offsets is made.
Columns other than the two named ones are ignored.
"""

from __future__ import annotations

import gc
import itertools
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_quality import blocks
from .shared import documents, new_folder

MAGIC = b"LXTOKEF1"
EVERY = 256
#: Characters that are encoded together, words in the younger half of the cache, documents of a shard at most.
STRETCH, CACHED_WORDS, SHARD_DOCS = 1 << 21, 200_000, 1 << 22
#: ASCII marks but the apostrophe: after letters, a run of them is a word of its own to the tokenizer.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


class EliasFano:
    """A non-decreasing sequence of integers from 0 in near-minimal space, with random access."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        shifts, low = np.arange(low_bits, dtype=np.uint64), b""
        for first in range(0, n, 1 << 16):  # whole bytes each
            bits = (v[first : first + (1 << 16), None] >> shifts) & np.uint64(1)
            low += np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(at[-1]) + 1, np.uint8)
        ones[at] = 1
        return cls(n, low_bits, low, np.packbits(ones, bitorder="little").tobytes(), at[::EVERY].astype("<u4").tobytes())

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.low, self.high.tobytes(), self.samples.tobytes()

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8 + 1], "little")
        return (chunk >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i, from the nearest sampled position on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        position, left = int(self.samples[i // EVERY]), i % EVERY
        byte = position // 8
        ones = np.unpackbits(self.high[byte : byte + 1], bitorder="little")[position % 8 :]
        base = position
        while True:
            found = np.flatnonzero(ones)
            if left < len(found):
                return ((base + int(found[left]) - i) << self.low_bits) | self._low(i)
            left -= len(found)
            byte += 1
            base = byte * 8
            ones = np.unpackbits(self.high[byte : byte + 1], bitorder="little")

    def slice(self, first: int, stop: int) -> np.ndarray:
        """Values first to stop - 1, decoded from the sampled position before the first to the one after the last."""
        if not 0 <= first < stop <= self.n:
            return np.zeros(0, np.int64)
        sample, after = first // EVERY, -(-stop // EVERY)
        begin = int(self.samples[sample])
        end = int(self.samples[after]) if after < len(self.samples) else len(self.high) * 8
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8 : (end + 7) // 8], bitorder="little")) + begin // 8 * 8
        ones = ones[np.searchsorted(ones, begin) + first - sample * EVERY :][: stop - first]
        high = ones - np.arange(first, stop)
        if not self.low_bits:
            return high.astype(np.int64)
        bit = first * self.low_bits
        raw = np.frombuffer(self.low[bit // 8 : (stop * self.low_bits + 7) // 8], np.uint8)
        bits = np.unpackbits(raw, bitorder="little")[bit % 8 :][: (stop - first) * self.low_bits]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        low = (bits.reshape(stop - first, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        return ((high.astype(np.uint64) << np.uint64(self.low_bits)) | low).astype(np.int64)

    def all(self) -> np.ndarray:
        return self.slice(0, self.n)


class Encoder:
    """Whole texts to id bytes. The tokenizer never looks across a space, so what stands between spaces is encoded once in a group of texts, and kept.

    Words of plain letters are encoded many at a time, without the tokenizer's own search for words, which these already
    are; each ends at the id whose token carries the end-of-word mark. The cache has a younger and an older half; what is
    used again moves to the younger one, which has ``cached`` words and what a group adds, at most.
    """

    def __init__(self, path: str, cached: int | None = None):
        from tokenizers import Tokenizer

        self.cached = CACHED_WORDS if cached is None else cached
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.word_end[i] = token.endswith("</w>")
        self.batched = self.word_end.any()
        whole_words = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        rules = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": whole_words}}
        self.of_words = Tokenizer.from_str(json.dumps(rules)) if self.batched else self.tokenizer
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        known, older = self.known, self.older
        again = older.keys() & chunks
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        chunks = chunks - again
        if not self.batched:
            known.update((chunk, self._plain(chunk)) for chunk in chunks)
            return
        words = set(filter(str.islower, filter(str.isascii, filter(str.isalpha, chunks))))
        later = []
        for chunk in chunks - words:
            word = chunk.rstrip(MARKS)
            if word.isalpha() and (word.isascii() or (max(word) < "ɐ" and "İ" not in word)):
                later.append((chunk, word.lower(), chunk[len(word) :]))
            else:
                known[chunk] = self._plain(chunk)
        words.update(word for _, word, _ in later if word not in known)
        if words:
            listed = list(words)
            ids = np.array(self.of_words.encode_batch_fast([" ".join(listed)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(listed):
                raw, edges = ids.tobytes(), [0, *(ends * ids.itemsize).tolist()]
                known.update(zip(listed, map(raw.__getitem__, map(slice, edges, edges[1:])), strict=True))
            else:
                for word in listed:
                    known[word] = self._plain(word)
        for chunk, word, mark in later:
            if mark not in known:
                known[mark] = self._plain(mark)
            known[chunk] = known[word] + known[mark]

    def _group(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text: different words are looked up once, and their ids then put in place of all words."""
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8).copy()
        raw[raw == 10] = 32
        ends = np.flatnonzero(raw == 32) + 1
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        # Each word keeps the space behind it, so that the bytes stay where they are.
        words = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        different = words.dictionary.buffers()[2].to_pybytes().decode().split(" ")[:-1]
        if len(self.known) > self.cached:
            self.known, self.older = {"": b""}, self.known
        if new := set(different).difference(self.known):
            self._learn(new)
        found = [self.known[word] for word in different]
        ids = np.frombuffer(b"".join(found), self.dtype)
        size = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
        at = words.indices.to_numpy()
        count = size[at]
        until = np.cumsum(count)
        ids = ids[np.repeat((np.cumsum(size) - size)[at] - until + count, count) + np.arange(until[-1])]
        last = np.searchsorted(ends, np.cumsum([len(text) + 1 for text in texts]))
        edges = [0, *until[last].tolist()]
        return [ids[a:z].tobytes() for a, z in itertools.pairwise(edges)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes; texts of about ``STRETCH`` characters are encoded together, longer ones in stretches."""
        out: list[list[bytes]] = [[] for _ in texts]
        of, group, size = [], [], 0

        def flush() -> None:
            # What a group makes has no cycles, and looking for some in so many objects takes a sixth of the time.
            looking = gc.isenabled()
            gc.disable()
            try:
                for i, ids in zip(of, self._group(group) if group else [], strict=True):
                    out[i].append(ids)
            finally:
                if looking:
                    gc.enable()
            of.clear()
            group.clear()

        for i, text in enumerate(texts):
            # The tokenizer lowers letters itself, but knows its control tokens by their case; beyond ASCII, order matters.
            if text.isascii() and "<|" not in text:
                text = text.lower()
            at = 0
            while at < len(text):
                cut = len(text) if len(text) - at <= STRETCH else text.find(" ", at + STRETCH)
                cut = len(text) if cut < 0 else cut
                of.append(i)
                group.append(text[at:cut].encode())
                size, at = size + cut - at, cut
                if size >= STRETCH:
                    flush()
                    size = 0
        flush()
        return [parts[0] if len(parts) == 1 else b"".join(parts) for parts in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


#: Encoders by path and size of cache: a worker keeps what it has learned from one task to the next.
_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder_of(path: str, cached: int | None = None) -> Encoder:
    if (path, cached) not in _encoders:
        _encoders[path, cached] = Encoder(path, cached)
    return _encoders[path, cached]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Streams one shard to a name of its own and renames it when it is whole, so a task that is run again leaves one file."""

    def __init__(self, uri: str, dtype: str):
        self.files, self.path = _open(uri)
        self.dtype, self.part = dtype, f"{self.path}.{uuid.uuid4().hex}.part"
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.part)
        self.ends, self.ids, self.nulls, self.total, self.bytes = array("q"), array("q"), 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.bytes += len(ids)
        self.total += len(ids) // int(self.dtype[2])
        self.ends.append(self.total)
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.append(doc_id)

    def close(self) -> tuple[int, int]:
        base = self.ids[0] if self.ids else 0
        footer = {"dtype": self.dtype, "docs": len(self.ends), "tokens": self.total, "nulls": self.nulls, "base": base, "ids_bytes": self.bytes}
        at = self.bytes
        # Differences of 64-bit ids can exceed a signed 64-bit integer, hence unsigned arithmetic.
        shifted = np.frombuffer(self.ids, np.int64).astype(np.uint64) - np.array(base, np.int64).astype(np.uint64) if self.ids else np.zeros(0)
        for name, values in (("ends", np.frombuffer(self.ends, np.int64) if self.ends else np.zeros(0)), ("doc_ids", shifted)):
            sequence = EliasFano.encode(values)
            sizes = []
            for part in sequence.parts():
                self.out.write(part)
                sizes.append(len(part))
            footer[name] = {"n": sequence.n, "low_bits": sequence.low_bits, "at": at, "sizes": sizes}
            at += sum(sizes)
        raw = json.dumps(footer).encode()
        self.out.write(raw + struct.pack("<I", len(raw)) + MAGIC)
        self.out.close()
        self.files.move(self.part, self.path)
        return len(self.ends), self.total


class Shard:
    """Random access to one shard: ``offset(i)`` and ``ids(i)`` of document i."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        length = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(self.file.read_at(length, size - 12 - length))
        self.dtype = np.dtype(self.footer["dtype"])
        self.ends, self._ids = self._sequence("ends"), self._sequence("doc_ids")

    def _sequence(self, name: str) -> EliasFano:
        meta, at, parts = self.footer[name], self.footer[name]["at"], []
        for size in meta["sizes"]:
            parts.append(self.file.read_at(size, at) if size else b"")
            at += size
        return EliasFano(meta["n"], meta["low_bits"], *parts)

    def __len__(self) -> int:
        return self.footer["docs"]

    def offset(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def doc_ids(self, first: int, stop: int) -> list[int | None]:
        """The ids of documents first to stop - 1; null ones stand first in a shard."""
        nulls = self.footer["nulls"]
        known = self._ids.slice(max(0, first - nulls), max(0, stop - nulls))
        known = (known.astype(np.uint64) + np.array(self.footer["base"], np.int64).astype(np.uint64)).astype(np.int64)
        return [None] * (min(stop, nulls) - min(first, nulls)) + known.tolist()

    def offsets(self, first: int, stop: int) -> np.ndarray:
        """Where documents first to stop - 1 begin, and where the last one ends."""
        return np.concatenate([[self.offset(first)], self.ends.slice(first, stop)])

    def ids(self, i: int) -> np.ndarray:
        return self.span(self.offset(i), self.offset(i + 1))

    def span(self, first: int, end: int) -> np.ndarray:
        step = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - first) * step, first * step), self.dtype) if end > first else np.zeros(0, self.dtype)


def write_token_shards(df: DataFrame, folder: str, tokenizer: str, *, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = 256 << 20) -> list[tuple[str, int, int]]:
    """Writes every row's ids, an end id after each, and returns the manifest: (file, documents, ids) in order.

    The manifest has one line for each ``shard_bytes`` of output at most, plus one a task.
    """
    ordered = df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, done = None, []
        task = TaskContext.get().partitionId()

        def finish() -> None:
            done.append((task, len(done), uri, *writer.close()))

        for rows, texts in blocks(batches, STRETCH):
            encoder = encoder_of(tokenizer)
            end = np.array([end_id], encoder.dtype).tobytes()
            for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.encode_all(texts), strict=True):
                if writer is None:
                    uri = f"{folder}/shard-{task:06d}-{len(done):04d}.tok"
                    writer = ShardWriter(uri, encoder.dtype)
                writer.add(doc_id, ids + end)
                if writer.bytes >= shard_bytes or len(writer.ends) >= SHARD_DOCS:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["task", "part", "file", "docs", "tokens"])

    rows = ordered.mapInArrow(write, "task int, part int, file string, docs long, tokens long").collect()
    return [(r.file, r.docs, r.tokens) for r in sorted(rows, key=lambda r: (r.task, r.part))]


def read_token_shards(spark: SparkSession, manifest: list[tuple[str, int, int]], *, block: int = 1 << 21) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file."""
    starts, base = [], 0
    for file, _, tokens in manifest:
        starts.append((file, base))
        base += tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri)
                for low in range(0, len(shard), 16 * EVERY):
                    high = min(len(shard), low + 16 * EVERY)
                    edges, doc_ids, at = shard.offsets(low, high), shard.doc_ids(low, high), 0
                    begins, ends = edges[:-1], edges[1:]
                    while at < high - low:
                        stop = max(at + 1, int(np.searchsorted(ends, begins[at] + block, "right")))
                        ids = memoryview(shard.span(int(begins[at]), int(ends[stop - 1])).astype("<u4")).cast("B")
                        here, to = (begins[at:stop] - begins[at]) * 4, (ends[at:stop] - begins[at]) * 4
                        crc = [zlib.crc32(ids[a:b]) for a, b in zip(here.tolist(), to.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids[at:stop], pa.int64()), pa.array(begins[at:stop] + first), pa.array(ends[at:stop] - begins[at:stop]), pa.array(crc, pa.int64()), pa.array([uri] * (stop - at))],
                            ["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                        )
                        at = stop

    files = spark.createDataFrame(starts, "file string, base long")
    if len(starts) > 1:
        files = files.repartition(min(len(starts), 10_000))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(spark: SparkSession, df: DataFrame) -> DataFrame:
    folder = new_folder(spark, "tokens")
    return read_token_shards(spark, write_token_shards(df, folder, default_tokenizer()))


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, documents(spark, sf_dir))
