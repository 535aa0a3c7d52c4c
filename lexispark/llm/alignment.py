"""Alignment of two tokenizers over a corpus: which ids of A and B end at the same bytes, how often, and how well each document agrees.

A is a byte-level BPE file of the tokenizers library, which reads a space and the text; B is a sentencepiece model, which adds that space itself.
Byte offsets where tokens of both end cut a text into groups, and the two tokens that end there are a link.

1. Neither tokenizer merges across the border between a character that isn't white space and a space or newline. So a text is cut there, and what
   stands between is aligned once in a block of documents, and kept. A block (``BLOCK`` bytes of text, one document at least) leaves
   one row for each document with its units, one row with the pairs of ids of each different unit, and for each stripe
   the block's different pairs with their numbers. A pair that is everywhere is one entry a block.
2. Pairs are dealt by stripe: B's id modulo ``STRIPES``. A stripe is a dense matrix of counts, a row for each of its B ids and a column for each A id
   that it meets, summed up with ``np.add.at``; each row's maximum is the B id's best count. Where
   there are more than ``STRIPE_ROWS`` rows a stripe, they are dealt on by a salt first and summed up in two steps.
3. The same pairs, dealt by the same stripes, meet the counts of their stripe and get theirs. What comes back to each block is one
   number a pair, which its units and then its documents sum up.

Results are exact. Task memory: one block (one document at least), one stripe's matrix, or one block's different pairs.

Cases: a null or empty text, and one whose tokens of A or B don't spell a space and the text (say, one with U+2581), has no tokens: its numbers are 0 and its
``groups_sha256`` is ''. Control strings inside texts are plain text. Rows are told apart by their place, so null and
repeated doc_ids and repeated rows each keep a row. An empty table gives no rows. Columns other than the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_quality import blocks
from .shared import discard, documents, materialize

BLOCK, STRIPES, STRIPE_ROWS = 4 << 20, 256, 4096
#: Units in the younger half of the cache, letters of the longest one that is kept, and units that are aligned together.
CACHED_UNITS, LONGEST_CACHED, TOGETHER = 60_000, 100, 16_384

_SPACE_MARK = "▁"
_BORDER = re.compile(r"(?<=\S)(?=[ \n])")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Unit(NamedTuple):
    """What stands between two borders, aligned: its numbers, its groups with a semicolon behind each, and b_id * size_a + a_id of each link."""

    ok: bool
    n_a: int
    n_b: int
    n_groups: int
    groups: str
    pairs: bytes


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocabulary, alphabet = self.a.get_vocab(with_added_tokens=True), byte_alphabet()
        self.size_a = max(vocabulary.values()) + 1
        self.bytes_a = [b""] * self.size_a
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        numbers = range(max(self.size_a, len(pieces)))
        self.text_comma, self.text_bar, self.text_end = (np.array([f"{i}{c}" for i in numbers], object) for c in ",|;")
        #: No piece goes on after a space or holds a newline: then B can be cut there too.
        self.cuts = not any(_SPACE_MARK in p.lstrip(_SPACE_MARK) or "\n" in p for p in pieces)
        self.space = self.b.piece_to_id(_SPACE_MARK)
        self.known: dict[str, Unit] = {}
        self.older: dict[str, Unit] = {}

    def units_of(self, text: str) -> list[str]:
        """A space and the text, cut where no token of either goes across."""
        return _BORDER.split(" " + text) if self.cuts else [" " + text]

    def _ids_b(self, units: list[str]) -> list[list[int]]:
        """B adds a space in front: it stands for a unit's own first space, and in front of a newline it's a token to drop."""
        ids = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [[self.space] if u == " " else i if u[0] == " " else i[1:] if i[:1] == [self.space] else [] for u, i in zip(units, ids, strict=True)]

    def _spelled(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Which units both tokenizers' tokens spell; all of them are looked at together first."""
        whole = b"".join(raw)
        spell = lambda table, ids: b"".join(map(table.__getitem__, ids))
        sides = ((self.bytes_a, self.length_a, a), (self.bytes_b, self.length_b, b))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ok = np.ones(len(raw), bool)
        for table, length, ids in sides:
            flat, first = _flat(ids)
            if (_sums(length[flat], first) != sizes).any() or spell(table, flat.tolist()) != whole:
                ok &= np.fromiter((spell(table, i) == r for i, r in zip(ids, raw, strict=True)), bool, len(raw))
        return ok

    def align(self, units: list[str]) -> list[Unit]:
        """All units at once: their tokens end to end, so that a border between units is one where both tokenizers end."""
        if not units:
            return []
        raw = [u.encode() for u in units]
        of_a, of_b = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)], self._ids_b(units)
        ok = self._spelled(raw, of_a, of_b)
        if not ok.all():
            good = iter(self.align([u for u, o in zip(units, ok.tolist(), strict=True) if o]))
            return [next(good) if o else Unit(False, 0, 0, 0, "", b"") for o in ok.tolist()]
        (a, first_a), (b, first_b) = _flat(of_a), _flat(of_b)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        place = np.searchsorted(ends_b, ends_a)
        last_a = ends_b[place] == ends_a
        at_a, at_b = np.flatnonzero(last_a), place[last_a]
        last_b = np.zeros(len(b), bool)
        last_b[at_b] = True
        # Each token's text goes behind those of its group and of the groups before: A's ids, then B's.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        texts = np.empty(len(a) + len(b), object)
        texts[np.arange(len(a)) + np.concatenate([[0], at_b + 1])[group_a]] = np.where(last_a, self.text_bar[a], self.text_comma[a])
        texts[np.arange(len(b)) + (at_a + 1)[group_b]] = np.where(last_b, self.text_end[b], self.text_comma[b])
        pairs = (b[at_b] * self.size_a + a[at_a]).tobytes()
        n_a, n_b = np.diff(first_a, append=len(a)), np.diff(first_b, append=len(b))
        n_groups = _sums(last_a.astype(np.int64), first_a)
        text_ends, pair_ends, texts = np.cumsum(n_a + n_b).tolist(), (np.cumsum(n_groups) * 8).tolist(), texts.tolist()
        counts = zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), [0, *text_ends], text_ends, [0, *pair_ends], pair_ends, strict=False)
        return [Unit(True, x, y, z, "".join(texts[s:e]), pairs[i:j]) for x, y, z, s, e, i, j in counts]

    def look_up(self, units: list[str], often: np.ndarray) -> list[Unit]:
        """Aligned units, which must be different. Those that occur often are kept; what is used again stays in the younger half of the cache."""
        if len(self.known) > CACHED_UNITS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        known.update((u, older[u]) for u in older.keys() & set(units))
        fresh = [u for u in units if u not in known]
        aligned: dict[str, Unit] = {}
        for at in range(0, len(fresh), TOGETHER):
            some = fresh[at : at + TOGETHER]
            aligned.update(zip(some, self.align(some), strict=True))
        found = [known[u] if u in known else aligned[u] for u in units]
        known.update((u, x) for u, x, o in zip(units, found, often.tolist(), strict=True) if o and len(u) <= LONGEST_CACHED)
        return found


#: Aligners by their files: a worker keeps what it has learned from one task to the next.
_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids end to end, and the place of each list's first one."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes


def split_units(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The units of all texts, each with a space in front, and the place of each text's first one.

    The same borders as ``Aligner.units_of``, found in the bytes of all texts at once.
    """
    parts = [b" " + t.encode() for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    at = np.flatnonzero((raw == 32) | (raw == 10))
    at = at[at > 0]
    x, y, z = raw[at - 1], raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    blank = ((x >= 9) & (x <= 13)) | ((x >= 28) & (x <= 32)) | ((y == 0xC2) & ((x == 0x85) | (x == 0xA0)))
    # U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
    blank |= (z == 0xE1) & (y == 0x9A) & (x == 0x80) | (z == 0xE3) & (y == 0x80) & (x == 0x80) | (z == 0xE2) & (y == 0x81) & (x == 0x9F)
    blank |= (z == 0xE2) & (y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF))
    cut = np.zeros(len(raw), bool)
    cut[at[~blank]] = cut[starts] = True
    offsets = np.flatnonzero(cut)
    units = pa.LargeStringArray.from_buffers(len(offsets), pa.py_buffer(np.append(offsets, len(raw)).astype(np.int64)), pa.py_buffer(raw))
    return units.dictionary_encode(), np.searchsorted(offsets, starts)


DOCUMENT, UNITS, PAIRS = 0, 1, 2
#: Rows of a block. A document's ``a`` are its units; the units' row has in ``a`` how many pairs each has and in ``b`` which ones;
#: a stripe's row has in ``a`` its pairs, in ``b`` how often each is in the block, and in ``first`` the place of its first pair.
ROWS = "kind int, block long, nth int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, stripe int, first long, a binary, b binary"
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _rows(batch: pa.RecordBatch, names: str) -> Iterator[tuple]:
    """The named columns row by row; binaries are views of the batch, not copies."""
    columns = [batch.column(batch.schema.get_field_index(name)) for name in names.split()]
    read = [map(lambda x: x.as_buffer(), c) if pa.types.is_binary(c.type) else iter(c.to_pylist()) for c in columns]
    return zip(*read, strict=True)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches that begin at ``first``; an empty one sums to 0."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[np.append(first[1:], len(values))] - upto[first]


def _block_rows(aligner: Aligner, block: int, doc_ids: list, texts: list[str], stripes: int) -> list[tuple]:
    empty = lambda nth: (DOCUMENT, block, nth, doc_ids[nth], 0, 0, 0, "", None, None, b"", None)
    rows = [empty(nth) for nth, text in enumerate(texts) if not text]
    places = [nth for nth, text in enumerate(texts) if text]
    if not places:
        return rows
    if aligner.cuts:
        split, first = split_units([texts[nth] for nth in places])
    else:
        split, first = pa.array([" " + texts[nth] for nth in places], pa.large_string()).dictionary_encode(), np.arange(len(places))
    of = split.indices.to_numpy()
    units = aligner.look_up(split.dictionary.to_pylist(), np.bincount(of, minlength=len(split.dictionary)) > 1)
    spelled, *numbers, groups, pairs_of = zip(*units, strict=True)
    ok = _sums(~np.array(spelled)[of], first) == 0
    sums = [_sums(np.array(n)[of], first).tolist() for n in numbers]
    edges = np.append(first, len(of)).tolist()
    used = np.bincount(of[np.repeat(ok, np.diff(edges))], minlength=len(units))
    for i, nth in enumerate(places):
        if not ok[i]:
            rows.append(empty(nth))
            continue
        own = of[edges[i] : edges[i + 1]]
        digest = hashlib.sha256("".join(map(groups.__getitem__, own.tolist()))[:-1].encode()).hexdigest()
        rows.append((DOCUMENT, block, nth, doc_ids[nth], sums[0][i], sums[1][i], sums[2][i], digest, None, None, own.astype("<u4").tobytes(), None))
    # Different pairs of the block, by stripe, and how often each occurs in its documents.
    size = np.array(numbers[2])
    flat = np.frombuffer(b"".join(pairs_of), np.int64)
    pairs, place = np.unique(flat, return_inverse=True)
    times = np.zeros(len(pairs), np.int64)
    np.add.at(times, place, np.repeat(used, size))
    stripe = pairs // aligner.size_a % stripes
    order = np.argsort(stripe, kind="stable")
    rank = np.empty(len(pairs), np.int64)
    rank[order] = np.arange(len(pairs))
    rows.append((UNITS, block, -1, None, None, None, None, None, None, len(pairs), size.astype("<u4").tobytes(), rank[place].astype("<u4").tobytes()))
    pairs, times, stripe = pairs[order], times[order], stripe[order]
    begins = np.flatnonzero(np.diff(stripe, prepend=-1))
    for at, end in zip(begins.tolist(), [*begins[1:].tolist(), len(pairs)], strict=True):
        rows.append((PAIRS, block, -1, None, None, None, None, None, int(stripe[at]), at, pairs[at:end].tobytes(), times[at:end].tobytes()))
    return rows


def aligned_blocks(df: DataFrame, path_a: str, path_b: str, *, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK, stripes: int = STRIPES) -> DataFrame:
    """``ROWS`` of the blocks of a corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, block = aligner_of(path_a, path_b), TaskContext.get().partitionId() << 33
        doc_ids, texts, size = [], [], 0
        for rows, some in blocks(batches, block_bytes):
            doc_ids += rows.column(0).to_pylist()
            texts += some
            size += rows.nbytes
            if size >= block_bytes:
                yield _batch(_block_rows(aligner, block, doc_ids, texts, stripes))
                doc_ids, texts, size, block = [], [], 0, block + 1
        if texts:
            yield _batch(_block_rows(aligner, block, doc_ids, texts, stripes))

    plain = df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return plain.mapInArrow(run, ROWS)


#: A B id of a stripe: its A ids (64-bit), how often each pair is linked, and the largest of these numbers.
COUNTS = "stripe int, salt int, b_id int, best long, a binary, b binary"


class Stripe:
    """Counts of one stripe's pairs as a dense matrix: a row for each B id there is, a column for each A id there is."""

    def __init__(self, size_a: int):
        self.size_a = size_a
        self.rows, self.columns = np.full(0, -1, np.int64), np.full(size_a, -1, np.int64)
        self.b_ids: list[int] = []
        self.n_columns = 0
        self.counts = np.zeros((0, 0), np.int64)

    def add(self, pairs: np.ndarray, times: np.ndarray) -> None:
        b, a = np.divmod(pairs, self.size_a)
        if len(b) and b.max() >= len(self.rows):
            self.rows = np.append(self.rows, np.full(int(b.max()) + 1 - len(self.rows), -1, np.int64))
        fresh = np.unique(b[self.rows[b] < 0])
        self.rows[fresh] = np.arange(len(self.b_ids), len(self.b_ids) + len(fresh))
        self.b_ids += fresh.tolist()
        fresh = np.unique(a[self.columns[a] < 0])
        self.columns[fresh] = np.arange(self.n_columns, self.n_columns + len(fresh))
        self.n_columns += len(fresh)
        height, width = self.counts.shape
        if len(self.b_ids) > height or self.n_columns > width:
            # Room for half as many again, so that growing costs no more than adding.
            larger = np.zeros((max(height, len(self.b_ids) * 3 // 2), max(width, min(self.size_a, self.n_columns * 3 // 2))), np.int64)
            larger[:height, :width] = self.counts
            self.counts = larger
        np.add.at(self.counts, (self.rows[b], self.columns[a]), times)

    def of_rows(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """b_id, its largest count, its A ids, their counts."""
        a_ids = np.flatnonzero(self.columns >= 0)
        at = self.columns[a_ids]
        best = self.counts.max(axis=1, initial=0)
        for b_id in self.b_ids:
            row = self.counts[self.rows[b_id], at]
            held = np.flatnonzero(row)
            yield b_id, int(best[self.rows[b_id]]), a_ids[held], row[held]


def _counted(rows: DataFrame, keys: list[str], size_a: int) -> DataFrame:
    """Sums up pairs (binary ``a``, ``b``: pairs and times) by stripe and salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, Stripe(size_a)

        def finish() -> Iterator[pa.RecordBatch]:
            out = [(*key, b_id, best, a.tobytes(), n.tobytes()) for b_id, best, a, n in held.of_rows()] if key else []
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out[at : at + 64], strict=True), types, strict=True)], [x.split()[0] for x in COUNTS.split(", ")])

        for batch in batches:
            for stripe, salt, b_id, a, n in _rows(batch, "stripe salt b_id a b"):
                if (stripe, salt) != key:
                    yield from finish()
                    key, held = (stripe, salt), Stripe(size_a)
                pairs = np.frombuffer(a, np.int64)
                held.add(pairs if b_id is None else pairs + b_id * size_a, np.frombuffer(n, np.int64))
        yield from finish()

    return rows.repartition(*keys).sortWithinPartitions("stripe", "salt").mapInArrow(run, COUNTS)


@dataclass
class Alignment:
    blocks: DataFrame
    folders: list[str]
    size_a: int
    salts: int

    def pair_rows(self) -> DataFrame:
        salt = F.pmod(F.xxhash64("block"), F.lit(self.salts)).cast("int")
        return self.blocks.where(F.col("kind") == PAIRS).select("stripe", salt.alias("salt"), F.lit(None).cast("int").alias("b_id"), "a", "b", "block", "first")

    def discard(self) -> None:
        """Deletes the written tables; results that were not read yet can't be read after that."""
        discard(self.blocks.sparkSession, *self.folders)


def align(df: DataFrame, path_a: str, path_b: str, *, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK, stripes: int = STRIPES, stripe_rows: int = STRIPE_ROWS) -> Alignment:
    """Aligns all documents; what later steps read is a table in the shared folder."""
    held, folder = materialize(aligned_blocks(df, path_a, path_b, id_column=id_column, text_column=text_column, block_bytes=block_bytes, stripes=stripes), "aligned")
    n = held.where(F.col("kind") == UNITS).count()
    return Alignment(held, [folder], aligner_of(path_a, path_b).size_a, max(1, -(-n // stripe_rows)))


def pair_counts(aligned: Alignment) -> DataFrame:
    """One row per B id that is linked: stripe, b_id, best, a (A ids), b (their counts), as 64-bit binaries; a written table."""
    rows = aligned.pair_rows().select("stripe", "salt", "b_id", "a", "b")
    if aligned.salts > 1:
        rows = _counted(rows, ["stripe", "salt"], aligned.size_a).select("stripe", F.lit(0).alias("salt"), "b_id", "a", "b")
    counts, folder = materialize(_counted(rows.withColumn("salt", F.lit(0)), ["stripe"], aligned.size_a).drop("salt"), "pair-counts")
    aligned.folders.append(folder)
    return counts


def best_matches(counts: DataFrame) -> DataFrame:
    """The table of B ids and the A ids they are most often linked with, ties included: b_id, a_id, n_links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b_id, best, a, n in _rows(batch, "b_id best a b"):
                top = np.frombuffer(a, np.int64)[np.frombuffer(n, np.int64) == best]
                yield pa.RecordBatch.from_arrays([pa.array([b_id] * len(top), pa.int32()), pa.array(top, pa.int32()), pa.array([best] * len(top), pa.int64())], ["b_id", "a_id", "n_links"])

    return counts.select("b_id", "best", "a", "b").mapInArrow(run, "b_id int, a_id int, n_links long")


def _scored_pairs(aligned: Alignment, counts: DataFrame) -> DataFrame:
    """Each block's pairs of a stripe with their corpus-wide counts (64-bit) and whether these are the best of their B ids (bytes)."""
    size_a = aligned.size_a
    table = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(aligned.salts - 1))).alias("salt"), "b_id", "best", "a", "b", F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("first"))
    asked = aligned.pair_rows().select("stripe", "salt", "b_id", F.lit(None).cast("long").alias("best"), "a", "b", "block", "first")
    dealt = table.unionByName(asked).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.asc_nulls_last("b_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ready, pairs, n, best = None, False, [], [], []
        for batch in batches:
            out: list[tuple] = []
            for stripe, salt, b_id, top, a, b, block, first in _rows(batch, "stripe salt b_id best a b block first"):
                if (stripe, salt) != key:
                    key, ready, pairs, n, best = (stripe, salt), False, [], [], []
                if b_id is not None:
                    own = np.frombuffer(b, np.int64).copy()
                    pairs.append(np.frombuffer(a, np.int64) + b_id * size_a)
                    n.append(own)
                    best.append(own == top)
                    continue
                if not ready:
                    # B ids ascend, and each one's A ids do.
                    ready, listed, times, tops = True, np.concatenate(pairs), np.concatenate(n), np.concatenate(best)
                at = np.searchsorted(listed, np.frombuffer(a, np.int64))
                out.append((block, first, times[at].tobytes(), tops[at].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "first", "a", "b"])

    return dealt.mapInArrow(run, "block long, first long, a binary, b binary")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_RESULT = [pa.int64()] * 7 + [pa.string()]


def score(aligned: Alignment, counts: DataFrame) -> DataFrame:
    """One row per document: its tokens, groups and links, links with the best count of their B id, and the sum of its links' counts."""
    own = aligned.blocks.where(F.col("kind") != PAIRS).select("block", F.when(F.col("kind") == UNITS, 1).otherwise(2).alias("part"), F.col("first").alias("place"), "nth", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b")
    none = lambda kind: F.lit(None).cast(kind)
    got = _scored_pairs(aligned, counts).select("block", F.lit(0).alias("part"), F.col("first").alias("place"), F.lit(-1).alias("nth"), *(none("long").alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), none("string").alias("groups_sha256"), "a", "b")
    dealt = own.unionByName(got).repartition("block").sortWithinPartitions("block", "part", "place", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, best, of_unit = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            for block, part, doc_id, n_a, n_b, n_groups, digest, a, b in _rows(batch, "block part doc_id n_a n_b n_groups groups_sha256 a b"):
                if block != now:
                    now, n, best, of_unit = block, [], [], None
                if part == 0:
                    n.append(np.frombuffer(a, np.int64).copy())
                    best.append(np.frombuffer(b, bool).copy())
                elif part == 1:
                    first, pairs = np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<u4")
                    starts = np.cumsum(first) - first
                    if len(pairs):
                        of_unit = first, _sums(np.concatenate(best)[pairs].astype(np.int64), starts), _sums(np.concatenate(n)[pairs], starts)
                    n, best = [], []
                elif len(a):
                    units = np.frombuffer(a, "<u4")
                    out.append((doc_id, n_a, n_b, n_groups, *(int(x[units].sum()) for x in of_unit), digest))
                else:
                    out.append((doc_id, 0, 0, 0, 0, 0, 0, digest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), _RESULT, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return dealt.mapInArrow(run, RESULT)


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    aligned = align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return score(aligned, pair_counts(aligned))
