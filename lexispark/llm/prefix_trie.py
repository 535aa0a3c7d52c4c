"""The prefix trie of conversations, from a merge of sorted runs that knows how many turns neighbours share.

Conversations stand as sequences of 16-byte digests of their turns (role and text), so texts never leave the scan. Sequences are dealt
by ranges of (sequence, conv_id), which also splits a sequence that many conversations have. A task

1. sorts what it reads in runs of ``RUN_BYTES`` and notes for each sequence the number of turns it shares with the one before it (LCP);
   runs that don't fit go to files in the shared folder, and more than ``FAN_IN`` of them are merged in passes;
2. merges the runs with a loser tree whose entries carry their LCP with the last winner: of two entries the one that shares more comes first,
   and only where both share as much are turns compared, from there on;
3. keeps the path of open nodes as a stack. A sequence that shares L turns with the one before it finishes all
   nodes deeper than L. Finished nodes are written in that order and read backwards, so that each meets its parent's smallest member first.

Nodes on a task's first and last path may go on in its neighbours. These few alone (two paths a task) are summed up over
all tasks by a digest of their path; their own leaves and savings then go up their paths; nodes below them get their smallest member by
task and place. So no node, not even the root, is gathered anywhere row by row.

``ends_sha256`` of a node is one hash over its ids in order, which is sequential by definition. A node inside a task is hashed there; the ids of one that
spans tasks travel as pieces of text of some 100,000 ids, which are streamed through the hash in order, in bounded memory.

Cases: turns are ordered by number, null first; rows with the same number by the digest of role and text, and rows that
repeat are separate turns. Null roles and texts count as empty. Rows without a conv_id belong to no conversation and are left out. ``c % 5`` has the
sign of c. An empty table has no conversation and thus no node, not even a root. Texts of any length count as a whole. Other columns are ignored.
One conversation is a row of 24 bytes a turn in its tasks. Two different turns have the same digest with a chance of 1 in 10^14 among 10^12 turns.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialize, new_folder

WIDTH = 16
RUN_BYTES, FAN_IN, PART_BYTES = 16 << 20, 64, 64 << 20
#: Nodes of a block that is read backwards, turns of a segment, and ids of a piece of text.
NODES, SEGMENT_TURNS, PIECE_IDS = 1 << 15, 4096, 100_000


# Turns and rebuilt conversations.


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of the SHA-256 of the role's length in bytes, the role and the text."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, WIDTH)


def _segments(turns: DataFrame) -> DataFrame:
    """Pieces of conversations in order: base, conv_id, other (false for the base itself), part, nth, digests, sizes (64-bit).

    Turns are dealt by ranges of (conv_id, turn), so that a long conversation is dealt over many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    order = ("conv_id", F.asc_nulls_first("turn"), "digest")
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            digests, sizes = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            edges = np.union1d(np.flatnonzero(np.diff(ids)) + 1, np.arange(0, len(ids), SEGMENT_TURNS)).tolist()
            rows = []
            for a, z in zip(edges, [*edges[1:], len(ids)], strict=True):
                rows.append((int(ids[a]), part, nth, b"".join(digests[a:z]), sizes[a:z].tobytes()))
                nth += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["conv_id", "part", "nth", "digests", "sizes"])

    found = dealt.mapInArrow(run, "conv_id long, part int, nth long, digests binary, sizes binary")
    base = F.col("conv_id") - F.col("conv_id") % 5
    return found.select(base.alias("base"), "conv_id", (base != F.col("conv_id")).alias("other"), "part", "nth", "digests", "sizes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, path (digests of its turns), sizes: the first turns of its base conversation, then its own ones after as many.

    A conversation and its base have the same ``base``, so they meet in one task without a join; it holds the base's first
    turns and one conversation.
    """
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9)).cast("int")
    dealt = _segments(turns).withColumn("h", heads).repartition("base").sortWithinPartitions("base", "other", "conv_id", "part", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, head, digests, sizes, h = None, None, (b"", b""), [], [], 0

        def finish() -> tuple:
            nonlocal head
            own, bytes_of = b"".join(digests), b"".join(sizes)
            if now == base:
                head = own[: 8 * WIDTH], bytes_of[: 8 * 8]
            return now, head[0][: h * WIDTH] + own[h * WIDTH :], head[1][: h * 8] + bytes_of[h * 8 :]

        for batch in batches:
            out, size = [], 0
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("base", "conv_id", "digests", "sizes", "h")]
            for of_base, conv_id, d, s, n in zip(*columns, strict=True):
                if conv_id != now:
                    if now is not None:
                        out.append(finish())
                        size += len(out[-1][1])
                    if of_base != base:
                        base, head = of_base, (b"", b"")
                    now, digests, sizes, h = conv_id, [], [], n
                digests.append(d)
                sizes.append(s)
                if size > RUN_BYTES:
                    yield _paths(out)
                    out, size = [], 0
            if out:
                yield _paths(out)
        if now is not None:
            yield _paths([finish()])

    return dealt.mapInArrow(run, "conv_id long, path binary, sizes binary")


def _paths(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["conv_id", "path", "sizes"])


# Sorted runs and their merge. An entry is (path, conv_id, sizes, LCP with the entry before it).

Entry = tuple[bytes, int, bytes, int]


def shared_turns(a: bytes, b: bytes, at: int) -> int:
    """How many first turns two paths share, of which the first ``at`` are known to be equal."""
    most, step = min(len(a), len(b)) // WIDTH, 1
    while at < most:
        end = min(most, at + step)
        if a[at * WIDTH : end * WIDTH] != b[at * WIDTH : end * WIDTH]:
            n = (end - at) * WIDTH
            unlike = np.frombuffer(a, np.uint8, n, at * WIDTH) != np.frombuffer(b, np.uint8, n, at * WIDTH)
            return at + int(unlike.argmax()) // WIDTH
        at, step = end, step * 2
    return at


def sorted_run(rows: list[tuple[bytes, int, bytes]]) -> list[Entry]:
    """The rows in order, each with the number of turns it shares with the one before it (0 for the first)."""
    rows.sort(key=lambda r: r[:2])
    out, before = [], b""
    for path, conv_id, sizes in rows:
        out.append((path, conv_id, sizes, shared_turns(before, path, 0)))
        before = path
    return out


class LoserTree:
    """Merges sorted runs. Each entry's LCP is held against the last winner; comparing starts where both are known to agree."""

    def __init__(self, runs: list[Iterator[Entry]]):
        self.runs = runs
        self.n = 1 << max(0, (len(runs) - 1).bit_length())
        self.entries: list[Entry | None] = [next(run, None) for run in runs] + [None] * (self.n - len(runs))
        self.lcps = [0] * self.n
        self.losers = [0] * self.n
        self.compared = 0
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self._play(2 * node), self._play(2 * node + 1)
        self.losers[node], winner = self._match(a, b)
        return winner

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """Loser and winner; the loser's LCP is then that with the winner."""
        x, y = self.entries[a], self.entries[b]
        if x is None or y is None:
            return (a, b) if x is None else (b, a)
        if self.lcps[a] != self.lcps[b]:
            return (b, a) if self.lcps[a] > self.lcps[b] else (a, b)
        lcp = shared_turns(x[0], y[0], self.lcps[a])
        self.compared += lcp - self.lcps[a] + 1
        at = lcp * WIDTH
        first = (x[0][at : at + WIDTH], x[1]) <= (y[0][at : at + WIDTH], y[1])
        loser, winner = (b, a) if first else (a, b)
        self.lcps[loser] = lcp
        return loser, winner

    def __iter__(self) -> Iterator[Entry]:
        while (entry := self.entries[self.winner]) is not None:
            at = self.winner
            yield (*entry[:3], self.lcps[at])
            # A run's next entry shares with this winner what the run itself says.
            self.entries[at] = following = next(self.runs[at], None)
            self.lcps[at] = following[3] if following else 0
            node = (at + self.n) // 2
            while node:
                self.losers[node], at = self._match(self.losers[node], at)
                node //= 2
            self.winner = at


_RUN = pa.schema([("path", pa.binary()), ("conv_id", pa.int64()), ("sizes", pa.binary()), ("lcp", pa.int64())])


class Runs:
    """Sorted runs of one task: the last one in memory, others in files of the shared folder, which go when they are merged."""

    def __init__(self, folder: str, run_bytes: int = RUN_BYTES, fan_in: int = FAN_IN):
        self.files, self.path = pafs.FileSystem.from_uri(folder)
        self.run_bytes, self.fan_in = run_bytes, max(2, fan_in)
        self.rows: list[tuple[bytes, int, bytes]] = []
        self.size = 0
        self.written: list[str] = []

    def add(self, path: bytes, conv_id: int, sizes: bytes) -> None:
        self.rows.append((path, conv_id, sizes))
        self.size += len(path) + len(sizes) + 100
        if self.size > self.run_bytes:
            self.written.append(self._write(iter(sorted_run(self.rows))))
            self.rows, self.size = [], 0

    def _write(self, entries: Iterator[Entry]) -> str:
        name = f"{self.path}/run-{uuid.uuid4().hex}"
        self.files.create_dir(self.path, recursive=True)
        with self.files.open_output_stream(name) as out, pa.ipc.new_stream(out, _RUN) as writer:
            some, size = [], 0
            for entry in entries:
                some.append(entry)
                size += len(entry[0]) + len(entry[2]) + 100
                if size > self.run_bytes // self.fan_in:
                    writer.write_batch(pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*some, strict=True), _RUN, strict=True)], schema=_RUN))
                    some, size = [], 0
            if some:
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*some, strict=True), _RUN, strict=True)], schema=_RUN))
        return name

    def _read(self, name: str) -> Iterator[Entry]:
        with self.files.open_input_stream(name) as source, pa.ipc.open_stream(source) as reader:
            for batch in reader:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
        self.files.delete_file(name)

    def merged(self) -> Iterator[Entry]:
        last, self.rows = sorted_run(self.rows), []
        while len(self.written) >= self.fan_in:
            some, self.written = self.written[: self.fan_in], self.written[self.fan_in :]
            self.written.append(self._write(iter(LoserTree([self._read(name) for name in some]))))
        if not self.written:
            return iter(last)
        return iter(LoserTree([*(self._read(name) for name in self.written), iter(last)]))


# The path of open nodes.

#: What a finished node is: depth, smallest member, members, children, leaves, saved tokens, its parent's slot or -1, hash of its ends.
_NODE = np.dtype([("depth", "<i8"), ("least", "<i8"), ("n", "<i8"), ("children", "<i8"), ("leaves", "<i8"), ("saved", "<i8"), ("slot", "<i8"), ("ends", "S64")])


def ids_hash(ids: array) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class Open:
    """A node whose subtree isn't finished. Leaves and savings are those of finished nodes below it."""

    __slots__ = ("bytes", "children", "ends", "leaves", "least", "n", "saved", "seam")

    def __init__(self, size: int, seam: bool):
        self.bytes, self.seam = size, seam
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends = array("q")

    def take(self, least: int, n: int, leaves: int, saved: int) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.n += n
        self.leaves += leaves
        self.saved += saved


class Backwards:
    """Blocks of finished nodes, read from the last to the first; all but the newest block are in a file of the shared folder."""

    def __init__(self, folder: str, block: int = NODES):
        self.files, self.path = pafs.FileSystem.from_uri(folder)
        self.block, self.rows, self.blocks = block, [], 0
        self.name = f"{self.path}/nodes-{uuid.uuid4().hex}"
        self.out = None

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) == self.block:
            if self.out is None:
                self.files.create_dir(self.path, recursive=True)
                self.out = self.files.open_output_stream(self.name)
            self.out.write(np.array(self.rows, _NODE).tobytes())
            self.rows, self.blocks = [], self.blocks + 1

    def __iter__(self) -> Iterator[tuple]:
        yield from reversed(self.rows)
        self.rows = []
        if self.out is not None:
            self.out.close()
            step = self.block * _NODE.itemsize
            with self.files.open_input_file(self.name) as source:
                for at in range(self.blocks - 1, -1, -1):
                    yield from reversed(np.frombuffer(source.read_at(step, at * step), _NODE).tolist())
            self.files.delete_file(self.name)


NODE, SEAM, PIECE = 0, 1, 2
#: Rows of a task. A node's ``parent`` is its parent's smallest member, or null and ``slot`` the place of its parent among the
#: task's seam nodes. A seam node has its own ``slot``, its parent's in ``above``, and digests of both their paths; a piece holds ids of a seam node's ends.
ROWS = "kind int, part int, slot long, above long, key binary, parent_key binary, depth long, least long, parent long, n long, children long, leaves long, saved long, bytes long, nth long, ends string"
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 9, pa.string()]
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _prefix_keys(path: bytes) -> list[bytes]:
    """A digest of each first part of a path, from the empty one on."""
    running = hashlib.sha256()
    keys = [running.digest()[:WIDTH]]
    for at in range(0, len(path), WIDTH):
        running.update(path[at : at + WIDTH])
        keys.append(running.digest()[:WIDTH])
    return keys


def path_nodes(part: int, entries: Iterator[Entry], folder: str, block: int = NODES) -> Iterator[tuple]:
    """Rows of one task's sorted conversations. The slot of a node on the first path is its depth; those of the last path come behind these."""
    done, first, last, stack = Backwards(folder, block), None, b"", []
    seams: list[tuple[int, Open]] = []

    def close() -> None:
        node, depth = stack.pop(), len(stack)
        above = stack[-1]
        if node.seam:
            seams.append((depth, node))
            above.take(node.least, node.n, node.leaves, node.saved)
            return
        leaves, saved = node.leaves + (node.children == 0), node.saved + (node.n - 1) * node.bytes
        done.add((depth, node.least, node.n, node.children, leaves, saved, depth - 1 if above.seam else -1, ids_hash(node.ends).encode()))
        above.children += 1
        above.take(node.least, node.n, leaves, saved)

    for path, conv_id, sizes, lcp in entries:
        if first is None:
            first, stack = path, [Open(0, True)]
        while len(stack) - 1 > lcp:
            close()
        stack += [Open(size, path is first) for size in np.frombuffer(sizes, "<i8")[len(stack) - 1 :].tolist()]
        stack[-1].ends.append(conv_id)
        stack[-1].take(conv_id, 1, 0, 0)
        last = path
    if first is None:
        return
    # What is open now is the last path, which may go on in the next task.
    behind = len(first) // WIDTH + 1
    of_first, of_last, opened = _prefix_keys(first), _prefix_keys(last), len(stack)
    slot_of = [depth if node.seam else behind + depth for depth, node in enumerate(stack)]
    for node, above in zip(stack[:0:-1], stack[-2::-1], strict=True):
        above.take(node.least, node.n, node.leaves, node.saved)
    listed = [(depth, node, slot_of[depth], slot_of[depth - 1] if depth else None, of_last) for depth, node in enumerate(stack)]
    listed += [(depth, node, depth, depth - 1, of_first) for depth, node in seams]
    for depth, node, slot, above, keys in listed:
        yield SEAM, part, slot, above, keys[depth], keys[depth - 1] if depth else None, depth, node.least, None, node.n, node.children, node.leaves, node.saved, node.bytes, None, None
        for nth, at in enumerate(range(0, len(node.ends), PIECE_IDS)):
            yield PIECE, part, slot, None, keys[depth], None, depth, None, None, None, None, None, None, None, nth, ",".join(map(str, node.ends[at : at + PIECE_IDS]))
    # Backwards, a node's parent is the latest node one level up that is still there, a seam of the first path, or the open node of that depth.
    above: list[tuple[int, int]] = []
    for depth, least, n, children, leaves, saved, slot, ends in done:
        while above and above[-1][0] >= depth:
            above.pop()
        inner = slot < 0 and bool(above) and above[-1][0] == depth - 1
        if slot < 0 and not inner:
            if depth > opened:
                raise RuntimeError("a node has no parent")
            slot = slot_of[depth - 1]
        yield NODE, part, None if inner else slot, None, None, None, depth, least, above[-1][1] if inner else None, n, children, leaves, saved, None, None, ends.decode()
        above.append((depth, least))


def trie_rows(conversations: DataFrame, folder: str, parts: int, *, run_bytes: int = RUN_BYTES, fan_in: int = FAN_IN, block: int = NODES) -> DataFrame:
    """``ROWS`` of rebuilt conversations (conv_id, path, sizes)."""
    dealt = conversations.select("path", "conv_id", "sizes").repartitionByRange(parts, "path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs = Runs(folder, run_bytes, fan_in)
        for batch in batches:
            for path, conv_id, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.add(path, conv_id, sizes)
        rows = []
        for row in path_nodes(TaskContext.get().partitionId(), runs.merged(), folder, block):
            rows.append(row)
            if len(rows) == 4096 or row[0] == PIECE:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return dealt.mapInArrow(run, ROWS)


NODES_OF = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _risen(chains: DataFrame) -> DataFrame:
    """key, leaves, saved: what each seam node of a task and those below it add themselves, summed up along the task's paths."""
    dealt = chains.select("part", "depth", "slot", "above", "key", "own_leaves", "own_saved").repartition("part").sortWithinPartitions("part", F.desc("depth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, {}
        for batch in batches:
            out = []
            for part, _, slot, above, key, leaves, saved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, waiting = part, {}
                more = waiting.pop(slot, (0, 0))
                leaves, saved = leaves + more[0], saved + more[1]
                out.append((key, leaves, saved))
                if above is not None:
                    up = waiting.get(above, (0, 0))
                    waiting[above] = up[0] + leaves, up[1] + saved
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["key", "leaves", "saved"])

    return dealt.mapInArrow(run, "key binary, leaves long, saved long")


def _hashed_ends(pieces: DataFrame) -> DataFrame:
    """key, ends: the hash over all pieces of a node's ids, in order."""
    dealt = pieces.select("key", "part", "nth", "ends").repartition("key").sortWithinPartitions("key", "part", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            out = []
            for key, ends in zip(batch.column(0), batch.column(3), strict=True):
                key, ends = key.as_py(), ends.as_py()
                if key == now:
                    running.update(b",")
                else:
                    if now is not None:
                        out.append((now, running.hexdigest()))
                    now, running = key, hashlib.sha256()
                running.update(ends.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in map(list, zip(*out, strict=True))], ["key", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], ["key", "ends"])

    return dealt.mapInArrow(run, "key binary, ends string")


def joined_nodes(rows: DataFrame) -> DataFrame:
    """All nodes of the trie (``NODES_OF``) from the rows of all tasks."""
    nodes, pieces = rows.where(F.col("kind") == NODE), rows.where(F.col("kind") == PIECE)
    chains = rows.where(F.col("kind") == SEAM).select("part", "slot", "above", "key", "parent_key", "depth", "least", "n", "children", "leaves", "saved", "bytes")
    total = lambda c: F.sum(c).alias(c)
    merged = chains.groupBy("key").agg(F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.min("least").alias("least"), F.min("part").alias("owner"), F.max("bytes").alias("bytes"), *map(total, ("n", "children", "leaves", "saved")))
    merged, of_merged = materialize(merged, "seams")
    below = merged.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("seam_children"))
    merged = merged.join(below, "key", "left").withColumn("children", F.col("children") + F.coalesce("seam_children", F.lit(0))).drop("seam_children")
    own = merged.select("key", "owner", F.when(F.col("children") == 0, 1).otherwise(0).cast("long").alias("own_leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("own_saved"))
    at_home = F.col("part") == F.col("owner")
    risen = _risen(chains.join(own, "key").withColumns({c: F.when(at_home, F.col(c)).otherwise(0) for c in ("own_leaves", "own_saved")}))
    risen = risen.groupBy("key").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    least = merged.select(F.col("key").alias("parent_key"), F.col("least").alias("parent"))
    none = hashlib.sha256().hexdigest()
    seams = merged.join(risen, "key").join(_hashed_ends(pieces), "key", "left").join(least, "parent_key", "left")
    seams = seams.select("least", "depth", "parent", "n", "children", (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("saved") + F.col("more_saved")).alias("saved"), F.coalesce("ends", F.lit(none)).alias("ends"))
    # A task's nodes below a seam ask for that task's own row of it, so that no seam is asked for by all tasks' nodes at once.
    of_slot = chains.select("part", "slot", "key").join(merged.select("key", F.col("least").alias("of_seam")), "key").drop("key")
    inner = nodes.join(of_slot, ["part", "slot"], "left").select("least", "depth", F.coalesce("parent", "of_seam").alias("parent"), "n", "children", "leaves", "saved", "ends")
    return inner.unionByName(seams).toDF(*NODES_OF)


def prefix_trie(turns: DataFrame, *, part_bytes: int = PART_BYTES, run_bytes: int = RUN_BYTES, fan_in: int = FAN_IN, block: int = NODES) -> DataFrame:
    """The trie of rebuilt conversations: one row per node (``NODES_OF``). ``turns`` has conv_id, turn, role and text."""
    spark = turns.sparkSession
    conversations, of_conversations = materialize(rebuilt(turns), "rebuilt")
    size = conversations.agg(F.coalesce(F.sum(F.octet_length("path") + F.octet_length("sizes") + 48), F.lit(0))).first()[0]
    folder = new_folder(spark, "runs")
    rows, _ = materialize(trie_rows(conversations, folder, max(1, -(-size // part_bytes)), run_bytes=run_bytes, fan_in=fan_in, block=block), "trie")
    discard(spark, folder, of_conversations)
    return joined_nodes(rows)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP11_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS turns,
    CAST(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 9 AS INT) AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS path
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, path, len(path) AS n, unnest(range(0, len(path) + 1)) AS depth FROM r),
node AS (
  SELECT path[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM p GROUP BY 1, 2),
kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(node.prefix[-1].text) END AS saved
  FROM node LEFT JOIN kids USING (prefix)),
up AS (
  SELECT prefix[1:d] AS prefix, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_node) GROUP BY 1)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_node f JOIN up ON up.prefix = f.prefix LEFT JOIN node q ON f.depth > 0 AND q.prefix = f.prefix[1:f.depth - 1]
"""
