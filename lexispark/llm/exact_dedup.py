"""Exact dedup against a minimal perfect hash over historical distinct digests.

A text's digest is the SHA-256 of its UTF-8 after each run of white space became
one space. The history's distinct digests are dealt into segments of about
``SEGMENT_KEYS``; each is a file of its own: a minimal perfect hash (levels of bit
arrays; a key that is alone at its bit stays there, the others go on to the next
level) and, slot by slot, the full 32-byte digest, the winner's doc_id and how many rows had it.
A lookup hashes to one slot and compares all 32 bytes, since a
minimal perfect hash sends strangers to some slot too. Members are repeats of that
slot's winner; the others are grouped among themselves.

A large group of copies is summed before the shuffle when the index is built. Digests with more than a
2,048th of all rows, 2,048 of them at most, are counted first, and their lookups dealt over as many pieces as they need, so no
task gets such a group whole; a task holds one segment at a time. Every segment has a file, an empty one too, and one that is
gone is an error.

Cases: a null text counts as empty. The smallest doc_id of a group stays; null is
larger than any. Rows that repeat both doc_id and text: one of them is kept. An
empty table, or an empty history, gives no rows, or no members. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, materialize, new_folder

MAGIC = b"LXMPHSEG"
SEGMENT_KEYS, LEVELS = 16_384, 48
#: A group of copies is large with more than this share of all rows and this many rows; its pieces have so many.
SHARE, PIECE_ROWS = 2048, 512


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (multiply, shift, xor)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _at_level(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """keys: n x 4 words of the digests."""
    with np.errstate(over="ignore"):
        return (_mix(keys[:, 0] + np.uint64(2 * level + 1) * _mix(keys[:, 1])) % np.uint64(bits)).astype(np.int64)


class MinimalPerfectHash:
    """n different keys to the slots 0 to n - 1, each slot once."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for taken in levels:
            self.ranks.append(base + np.cumsum(taken) - taken)
            base += int(taken.sum())
        self.n = base

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys repeat")
            bits = max(8, int(1.3 * len(left)))
            at = _at_level(left, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone.astype(np.int64))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for those that no level holds."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (taken, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = _at_level(keys[left], level, len(taken))
            here = taken[at] == 1
            out[left[here]] = rank[at[here]]
            left = left[~here]
        return out


@dataclass
class Segment:
    hash: MinimalPerfectHash
    digests: np.ndarray  # n x 4 words
    winners: np.ndarray
    unnamed: np.ndarray  # the winner's doc_id is null
    counts: np.ndarray

    @classmethod
    def build(cls, digests: np.ndarray, winners: list[int | None], counts: list[int]) -> Segment:
        mph = MinimalPerfectHash.build(digests)
        order = np.empty(len(digests), np.int64)
        order[mph.slots(digests)] = np.arange(len(digests))
        named = np.array([w or 0 for w in winners], np.int64)
        return cls(mph, digests[order], named[order], np.array([w is None for w in winners])[order], np.array(counts, np.int64)[order])

    def dump(self) -> bytes:
        levels = self.hash.levels
        head = struct.pack("<II", self.hash.n, len(levels)) + b"".join(struct.pack("<I", len(x)) for x in levels)
        bits = b"".join(np.packbits(x.astype(np.uint8)).tobytes() for x in levels)
        return MAGIC + head + bits + self.digests.tobytes() + self.winners.tobytes() + self.unnamed.astype(np.uint8).tobytes() + self.counts.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Segment:
        if raw[:8] != MAGIC:
            raise ValueError("no index segment")
        n, n_levels = struct.unpack_from("<II", raw, 8)
        sizes, at, levels = struct.unpack_from(f"<{n_levels}I", raw, 16), 16 + 4 * n_levels, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at))[:size].astype(np.int64))
            at += (size + 7) // 8
        digests = np.frombuffer(raw, np.uint64, 4 * n, at).reshape(n, 4)
        winners = np.frombuffer(raw, np.int64, n, at + 32 * n)
        unnamed = np.frombuffer(raw, np.uint8, n, at + 40 * n).astype(bool)
        return cls(MinimalPerfectHash(levels), digests, winners, unnamed, np.frombuffer(raw, np.int64, n, at + 41 * n))

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest that is a member, -1 for strangers; all 32 bytes are compared."""
        slots = self.hash.slots(digests)
        known = slots >= 0
        known[known] = (self.digests[slots[known]] == digests[known]).all(axis=1)
        return np.where(known, slots, -1)


def _words(column: pa.Array) -> np.ndarray:
    """Digests of an Arrow column as n x 4 words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


def digests_of(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("doc_id"), digest_of(F.col(text_column)).alias("digest"))


@dataclass
class Index:
    folder: str
    segments: int

    def segment_of(self, digest: str = "digest") -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(max(1, self.segments))).cast("int")


def build_index(digests: DataFrame, *, segment_keys: int = SEGMENT_KEYS) -> Index:
    """Writes the segments of a history: doc_id, digest, a row for each text that was seen."""
    spark = digests.sparkSession
    history, _ = materialize(digests.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n")), "history")
    index = Index(new_folder(spark, "mph"), -(-history.count() // segment_keys))
    folder = index.folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], []

        def finish() -> None:
            digests, winners, counts = (pa.concat_arrays([b.column(i).filter(b.column(0).is_valid()) for b in held]) for i in range(3))
            files, path = pafs.FileSystem.from_uri(f"{folder}/{now:08d}.mph")
            files.create_dir(path.rpartition("/")[0], recursive=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with files.open_output_stream(part) as out:
                out.write(Segment.build(_words(digests), winners.to_pylist(), counts.to_pylist()).dump())
            files.move(part, path)
            done.append(now)

        for batch in batches:
            segments = batch.column(3).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(segments)) + 1).tolist(), len(segments)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if now != segments[a]:
                    if held:
                        finish()
                    now, held = int(segments[a]), []
                held.append(batch.slice(a, b - a))
        if held:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], ["segment"])

    # A row without a digest stands for each segment, so that empty ones get their file.
    marks = spark.range(index.segments).select(F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("winner"), F.lit(0).cast("long").alias("n"), F.col("id").cast("int").alias("segment"))
    dealt = history.withColumn("segment", index.segment_of()).unionByName(marks).repartition("segment").sortWithinPartitions("segment")
    dealt.mapInArrow(write, "segment int").count()
    return index


def large_groups(digests: DataFrame) -> DataFrame:
    """Digests with more than their share of rows, at most ``SHARE`` of them, and the number of pieces of each."""
    groups, _ = materialize(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")), "groups")
    piece = max(PIECE_ROWS, (groups.agg(F.sum("rows")).first()[0] or 0) // SHARE)
    return groups.where(F.col("rows") > piece).select("digest", F.ceil(F.col("rows") / piece).cast("int").alias("pieces"))


def dealt_by(digests: DataFrame, large: DataFrame) -> DataFrame:
    """Adds ``salt``, 0 but for rows of large groups."""
    return digests.join(F.broadcast(large), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")


def look_up(digests: DataFrame, index: Index, large: DataFrame) -> DataFrame:
    """Adds to doc_id, digest: member, winner, n (the winner's rows in the history), first (false for a row that repeats another's doc_id and digest)."""
    folder, schema = index.folder, "doc_id long, digest binary, member boolean, winner long, n long, first boolean"
    dealt = dealt_by(digests, large).select("doc_id", "digest", index.segment_of().alias("segment"), "salt")
    dealt, n_segments = dealt.repartition("segment", "salt"), index.segments
    dealt = dealt.sortWithinPartitions("segment", "digest", F.asc_nulls_first("doc_id"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segment, last = None, None, None
        for batch in batches:
            segments = batch.column(2).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(segments)) + 1).tolist(), len(segments)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if now != segments[a]:
                    now = int(segments[a])
                    files, path = pafs.FileSystem.from_uri(f"{folder}/{now:08d}.mph")
                    segment = Segment.load(files.open_input_file(path).read()) if n_segments else None
                some = batch.slice(a, b - a)
                slots = segment.find(_words(some.column(1))) if segment else np.full(b - a, -1)
                member = slots >= 0
                first = []
                for row in zip(some.column(1).to_pylist(), some.column(0).to_pylist(), strict=True):
                    first.append(row != last)
                    last = row
                if segment:
                    winners = pa.array(segment.winners[slots], mask=~member | segment.unnamed[slots])
                    counts = pa.array(segment.counts[slots], mask=~member)
                else:
                    winners = counts = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(member), winners, counts, pa.array(first)], ["doc_id", "digest", "member", "winner", "n", "first"])

    return dealt.mapInArrow(find, schema)


def deduplicate(digests: DataFrame, index: Index) -> DataFrame:
    """Per row: doc_id, digest, member, keep_id, group_size, kept.

    A member's keep_id and group_size are the history's, and it is kept only if it is
    that winner itself; the others are grouped among themselves.
    """
    large, _ = materialize(large_groups(digests), "large")
    found, _ = materialize(look_up(digests, index, large), "found")
    members = found.where("member").select("doc_id", "digest", "member", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("winner")) & F.col("first")).alias("kept"))
    others = dealt_by(found.where("not member"), large)
    groups = others.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.join(F.broadcast(large), "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    grouped = others.join(groups, ["digest", "salt"]).select("doc_id", "digest", "member", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("first")).alias("kept"))
    return members.unionByName(grouped)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history is every row of ``documents``, so all rows are members and slots hold the smallest doc_id."""
    digests, _ = materialize(digests_of(documents(spark, sf_dir)), "digests")
    out = deduplicate(digests, build_index(digests))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
