"""Exact n-gram Jaccard self-join by PartEnum signatures, and the classes it links.

A document is its set of distinct 5-word shingles. Two sets of a and b shingles with a Jaccard
similarity of 4/5 or more differ in at most (a + b) / 9 of them. Sizes fall into bands that double;
each band has a scheme that hashes the shingle domain into n1 partitions, and a set's projection to a
partition, with the partition, is a token. Sets that differ in d shingles
differ in d partitions at most, so they share all but d of n1 tokens. Enumerating
one-partition subsets, a set emits its first d + 1 + e tokens in one order for all sets (projections with most shingles first, so
that a signature is as telling as can be; empty ones last), with d the bound for the largest
partner it can have. By the prefix argument two sets that are similar enough share e + 1 signatures or more, with the smaller e of the two. A set whose partners
may be in the next band also signs in that band's scheme.

How it runs: equal sets are one class, named by 64 bits of its hash and signed once a task. Signatures travel packed, six
bytes each, to buckets of about ``BUCKET`` bytes of text. Classes that share a signature are candidates. A class with no more
signatures in long lists than the least e of its partners leaves those lists, since each of its partners shares another
signature with it; so a passage that many documents contain makes no candidates of them. Lists of up to ``small_list``
classes give their pairs. In longer ones every member is compared with the hub, the member with the greatest
share of its signatures in long lists, which settles most groups of near copies; a group has the same hub in nearly all its
lists. Where members of a hub's lists are still in several components, those outside the largest one are compared
with all members, piece by piece, first by parity sketches, then by the shingles themselves. A piece gives links that join
two components each, so never more of them than it has members. Sets that differ in d shingles have sketches that
differ in d bits at most, so none is ruled out wrongly. No link between components is lost and none is added.

Cases: null, empty and blank texts have no shingles and link with nothing. With fewer words than 5 the sequence is one
shingle. Null doc_ids take part; a component's id is its smallest doc_id that is
not null. Equal rows link like others. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .line_quality import blocks
from .shared import discard, documents, materialize, may_hold

K, CACHED, BLOCK = 5, 100_000, 2 << 20
#: Bytes of text whose signatures share a bucket, and shingles that a piece of a long list holds.
BUCKET, PIECE = 32 << 20, 400_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each UTF-8 text; A-Z count as small letters, words end at ASCII white space."""
    split = [text.lower().split() for text in texts]
    counts = [len(w) for w in split]
    w = np.fromiter(map(_words.__getitem__, itertools.chain.from_iterable(split)), np.uint64, sum(counts))
    n, out, at = len(w), [], 0
    if n >= K:
        h = w[: n - K + 1] * ODD[0]
        for j in range(1, K):
            h = h + w[j : n - K + 1 + j] * ODD[j]
        h = mix(h)
    for count in counts:
        if count >= K:
            out.append(np.unique(h[at : at + count - K + 1]))
        elif count:
            out.append(mix((w[at : at + count] * ODD[:count]).sum(keepdims=True, dtype=np.uint64), count))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def band_of(n: np.ndarray) -> np.ndarray:
    """Band i holds the sizes from 2^i to 2^(i + 1) - 1."""
    return np.frexp(n.astype(float))[1] - 1


def partitions_of(band: np.ndarray) -> np.ndarray:
    """n1 of a band's scheme: more than the most differences plus 1, since prefixes skip the emptiest partitions."""
    top = 2 ** (band + 1) - 1
    return (8 * (2 * top // 9 + 1) + 4) // 5 + 2


def spare(need):
    """e: signatures that a set has beyond those that it needs to meet its partners."""
    return need // 4 + 2


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(set index, signature) of all signatures of non-empty sets, ordered by set."""
    n = np.array([len(s) for s in sets], np.int64)
    live = np.flatnonzero(n)
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size, band = n[live], band_of(n[live])
    top, largest = 2 ** (band + 1) - 1, 5 * n[live] // 4
    guest = largest > top
    # One entry for each set and scheme: the own band, and the next one where partners can be.
    owner = np.concatenate([live, live[guest]])
    scheme = np.concatenate([band, band[guest] + 1])
    need = np.concatenate([(size + np.minimum(top, largest)) // 9 + 1, (size[guest] + largest[guest]) // 9 + 1])
    n1 = partitions_of(scheme)
    need = np.minimum(n1, need + spare(need))
    elements = np.concatenate([sets[i] for i in owner])
    entry = np.repeat(np.arange(len(owner)), n[owner])
    place = mix(elements, 1) >> np.uint64(32)
    p = ((place * n1[entry].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    base = np.cumsum(n1) - n1
    slot = base[entry] + p
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    content = np.add.reduceat(mix(elements, 2)[order], first)
    count = np.diff(first, append=len(slot))
    slot = slot[first]
    entry = entry[order][first]
    p = slot - base[entry]
    rank_order = np.argsort((entry << 40) | ((65535 - np.minimum(count, 65535)) << 24) | p, kind="stable")
    entry, p, content, count = entry[rank_order], p[rank_order], content[rank_order], count[rank_order]
    begins = np.searchsorted(entry, np.arange(len(owner)))
    kept = np.arange(len(entry)) - begins[entry] < need[entry]
    short = np.flatnonzero(np.diff(begins, append=len(entry)) < need)
    entry_k, p_k, content_k = entry[kept], p[kept], content[kept]
    if len(short):  # too few partitions with shingles: the first empty ones stand in
        extra = []
        for e in short.tolist():
            a, z = begins[e], begins[e + 1] if e + 1 < len(begins) else len(entry)
            empty = np.setdiff1d(np.arange(n1[e]), p[a:z], assume_unique=True)[: need[e] - (z - a)]
            extra.append((np.full(len(empty), e), empty))
        entry_k = np.concatenate([entry_k, *(x[0] for x in extra)])
        p_k = np.concatenate([p_k, *(x[1] for x in extra)])
        content_k = np.concatenate([content_k, np.zeros(len(entry_k) - len(content_k), np.uint64)])
    sig = mix(content_k + p_k.astype(np.uint64) * ODD[0] + scheme[entry_k].astype(np.uint64) * ODD[1], 3)
    who = owner[entry_k]
    by_set = np.argsort(who, kind="stable")
    return who[by_set], sig[by_set]


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """Parities of the shingles' counts in 2 to 4 cells a shingle, a power of two and 64 at least.

    Sets that differ in d shingles have sketches that differ in d bits at most. The
    two halves of a sketch, added, are the sketch of half as many cells.
    """
    cells = [64 if len(s) < 16 else 4 << (len(s).bit_length() - 1) for s in sets]
    base = np.cumsum(cells) - cells
    at = np.concatenate([(mix(s, 7) & np.uint64(c - 1)).astype(np.int64) + b for s, c, b in zip(sets, cells, base.tolist(), strict=True)])
    raw = np.packbits((np.bincount(at, minlength=int(base[-1]) + cells[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[b // 8 : (b + c) // 8] for b, c in zip(base.tolist(), cells, strict=True)]


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The words of a sketch of ``size`` bytes or more, brought to that size."""
    words = np.frombuffer(sketch, np.uint64)
    while len(words) * 8 > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def pack(classes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, sig: np.ndarray) -> bytes:
    six = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return b"".join((np.uint32(len(classes)).tobytes(), classes.tobytes(), sizes.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), six.tobytes()))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, set size and six signature bytes of each signature."""
    m = int(np.frombuffer(blob, "<u4", 1)[0])
    classes, sizes, counts = np.frombuffer(blob, "<u8", m, 4), np.frombuffer(blob, "<u4", m, 4 + 8 * m), np.frombuffer(blob, "<u4", m, 4 + 12 * m)
    six = np.frombuffer(blob, np.uint8, offset=4 + 16 * m).reshape(-1, 6)
    sig = np.zeros((len(six), 8), np.uint8)
    sig[:, :6] = six
    return np.repeat(classes, counts), np.repeat(sizes, counts), sig.view("<u8").ravel()


def bucket_of(sig: np.ndarray, n_buckets: int) -> np.ndarray:
    """A signature's bucket, by its upper 31 bits; six lower bytes travel with it."""
    return ((sig >> np.uint64(33)) * np.uint64(n_buckets) >> np.uint64(31)).astype(np.int32)


def compatible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of which a Jaccard similarity of 4/5 is possible."""
    return 5 * np.minimum(a, b).astype(np.int64) >= 4 * np.maximum(a, b).astype(np.int64)


#: A row for each document, and a class's sketch beside the first of its documents in a task.
SETS = "doc_id long, rid long, n long, a long, b long, sketch binary"
SIGNED = f"{SETS}, bucket int, blob binary"
LISTED = f"{SETS}, list long, x long, nx long, y long, ny long"


def sign(docs: DataFrame, n_buckets: int) -> DataFrame:
    """A row for each document (doc_id, hash of its text, set size, class a, check b), dealt over the buckets in turn, and rows of packed signatures by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        turn = 0
        for rows, texts in blocks(batches, BLOCK, 2):
            with np.errstate(over="ignore"):
                sets = shingle_sets(texts)
                n = np.array([len(s) for s in sets], np.int64)
                every = np.concatenate(sets)
                at = np.minimum(np.cumsum(n) - n, max(0, len(every) - 1))
                a, b = (np.where(n > 0, np.add.reduceat(mix(every, s), at), 0).astype(np.uint64) if len(every) else np.zeros(len(n), np.uint64) for s in (4, 5))
                fresh = []
                for i, key in enumerate(a.tolist()):
                    if n[i] and key not in seen:
                        seen.add(key)
                        fresh.append(i)
                if len(seen) > 200_000:
                    seen.clear()
                who, sig = signatures([sets[i] for i in fresh])
                drawn: list[bytes | None] = [None] * len(n)
                for i, sketch in zip(fresh, sketches([sets[i] for i in fresh]) if fresh else [], strict=True):
                    drawn[i] = sketch
            docs_out = [rows.column(0), rows.column(1), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(drawn, pa.binary()), pa.array((np.arange(len(n)) + turn) % n_buckets, pa.int32()), pa.nulls(len(n), pa.binary())]
            turn += len(n)
            yield pa.RecordBatch.from_arrays(docs_out, names)
            if not len(sig):
                continue
            index = np.array(fresh)
            bucket = bucket_of(sig, n_buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, who, sig = bucket[order], who[order], sig[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = []
            for x, y in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=True):
                start = np.flatnonzero(np.diff(who[x:y], prepend=-1))
                of = index[who[x:y][start]]
                blobs.append(pack(a[of], n[of], np.diff(start, append=y - x), sig[x:y]))
            m = len(blobs)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, pa.int64()) for _ in range(5)), pa.nulls(m, pa.binary()), pa.array(bucket[edges]), pa.array(blobs, pa.binary())], names)

    names = [x.split()[0] for x in SIGNED.split(", ")]
    return docs.mapInArrow(run, SIGNED)


def match(signed: DataFrame, small_list: int, n_buckets: int) -> DataFrame:
    """Documents' rows as they come, and classes that share signatures: pairs (x, y) of short lists, members (list and x) of long ones, and how many (ny) signatures of x are in long lists.

    ``list`` is a hash of a long list's members, 0 for pairs and null for counts. Signatures travel once and aren't written.
    """

    def of_bucket(held: list[bytes]) -> pa.RecordBatch | None:
        parts = [unpack(blob) for blob in held]
        classes, sizes, sig = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((classes, sig))
        classes, sizes, sig = classes[order], sizes[order], sig[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (classes[1:] != classes[:-1])
        classes, sizes, sig = classes[fresh], sizes[fresh], sig[fresh]
        first = np.flatnonzero(np.diff(sig, prepend=sig[0] + np.uint64(1)))
        length = np.diff(first, append=len(sig))
        several = length > 1
        first, length = first[several], length[several]
        if not len(first):
            return None
        at = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
        with np.errstate(over="ignore"):
            lists = np.add.reduceat(mix(classes[at], 6), np.cumsum(length) - length)
        in_long = at[np.repeat(length > small_list, length)]
        busy, where, often = np.unique(classes[in_long], return_index=True, return_counts=True)
        busy_sizes = sizes[in_long][where]
        _, keep = np.unique(lists, return_index=True)
        first, length, lists = first[keep], length[keep], lists[keep]
        out = []
        for m in range(2, small_list + 1):
            starts = first[length == m]
            for i in range(m):
                for j in range(i + 1, m):
                    out.append((np.zeros(len(starts), np.uint64), starts + i, starts + j))
        pairs = [np.concatenate([o[i] for o in out]) for i in range(3)] if out else [np.zeros(0, np.int64)] * 3
        x, y = classes[pairs[1]], classes[pairs[2]]
        nx, ny = sizes[pairs[1]], sizes[pairs[2]]
        good = compatible(nx, ny)
        x, y, nx, ny = x[good], y[good], nx[good], ny[good]
        _, once = np.unique(np.stack([x, y], axis=1), axis=0, return_index=True) if len(x) else (None, np.zeros(0, np.int64))
        x, y, nx, ny = x[once], y[once], nx[once], ny[once]
        long = length > small_list
        at = np.repeat(first[long] - (np.cumsum(length[long]) - length[long]), length[long]) + np.arange(length[long].sum())
        none = len(at)
        columns = [
            pa.concat_arrays([pa.array(np.concatenate([np.zeros(len(x), np.uint64), np.repeat(lists[long], length[long])]).view(np.int64)), pa.nulls(len(busy), pa.int64())]),
            pa.array(np.concatenate([x, classes[at], busy]).view(np.int64)),
            pa.array(np.concatenate([nx, sizes[at], busy_sizes]).astype(np.int64)),
            pa.concat_arrays([pa.array(y.view(np.int64)), pa.nulls(none + len(busy), pa.int64())]),
            pa.concat_arrays([pa.array(ny.astype(np.int64)), pa.nulls(none, pa.int64()), pa.array(often.astype(np.int64))]),
        ]
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(columns[0]), kind) for kind in kinds), *columns], names)

    kinds = [*[pa.int64()] * 5, pa.binary()]
    names = [x.split()[0] for x in LISTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            of_docs = batch.filter(batch.column(7).is_null())
            yield pa.RecordBatch.from_arrays([*of_docs.columns[:6], *(pa.nulls(of_docs.num_rows, pa.int64()) for _ in range(5))], names)
            of_lists = batch.filter(batch.column(7).is_valid())
            for bucket, blob in zip(of_lists.column(6).to_pylist(), of_lists.column(7).to_pylist(), strict=True):
                if bucket != now:
                    if held and (found := of_bucket(held)):
                        yield found
                    now, held = bucket, []
                held.append(blob)
        if held and (found := of_bucket(held)):
            yield found

    return signed.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, LISTED)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def verify(pairs: DataFrame, texts: DataFrame, partners_in_place: int = 256) -> DataFrame:
    """Those (x, y) whose sets are similar enough. ``texts``: class a and text, for every class in a pair.

    Partners' texts travel to their hub's; a hub is in one more place for each ``partners_in_place`` of them.
    """
    # The class with more partners in the pair is x where the pair came from a long list.
    places = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / partners_in_place).alias("places"))
    placed = pairs.join(places, "x").withColumn("salt", F.pmod(F.xxhash64("y"), "places").cast("int"))
    partners = placed.join(texts.select(F.col("a").alias("y"), "text"), "y").select("x", "salt", "y", "text")
    hubs = placed.select("x", "salt").distinct().join(texts.select(F.col("a").alias("x"), "text"), "x").select("x", "salt", F.lit(None).cast("long").alias("y"), "text")
    together = hubs.unionByName(partners).repartition("x", "salt").sortWithinPartitions("x", "salt", F.asc_nulls_first("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, None
        for batch in batches:
            xs, ys = [], []
            texts, ids, others = batch.column(3).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at in range(0, len(texts), 200):
                with np.errstate(over="ignore"):
                    sets = shingle_sets(texts[at : at + 200])
                for x, y, s in zip(ids[at : at + 200], others[at : at + 200], sets, strict=True):
                    if y is None:
                        now, hub = x, s
                        continue
                    if x != now:
                        raise RuntimeError("a partner came before its hub")
                    if similar(hub, s):
                        xs.append(x)
                        ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])

    return together.select("x", "salt", "y", "text").mapInArrow(run, "x long, y long").distinct()


#: Links that one task contracts; it holds a number or two for each class in them.
CONTRACTED = 500_000


def contracted(links: DataFrame, parts: int) -> DataFrame:
    """(x, root): each task replaces its links by one from every class to the smallest one that its own links lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(x), top(y)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["x", "root"])

    return links.select("x", "y").repartition(parts).mapInArrow(run, "x long, root long")


def components(links: DataFrame, *, most_rounds: int = 60, contract_links: int = CONTRACTED) -> tuple[DataFrame, list[str]]:
    """Class to the smallest class that links lead to (x, root), for every class in a link, and the folders that hold this.

    Links are contracted in pieces of a bounded size. Where there is more than one piece, labels
    then go to neighbours and on to their label's label, until none changes.
    """
    spark = links.sparkSession
    parts = max(1, -(-links.count() // contract_links))
    shorter, folder_of_links = materialize(contracted(links, parts), "contracted")
    if parts == 1:
        return shorter, [folder_of_links]
    pairs = shorter.select("x", F.col("root").alias("y"))
    both, folder_of_both = materialize(pairs.union(pairs.select("y", "x")).distinct(), "links")
    labels, folder = materialize(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")), "labels")
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("x").alias("y"), F.col("root").alias("theirs")), "y").groupBy("x").agg(F.min("theirs").alias("theirs"))
        nearer = labels.join(seen, "x").select("x", F.least("root", "theirs").alias("near"), "root")
        jumped = nearer.join(labels.select(F.col("x").alias("near"), F.col("root").alias("further")), "near").select("x", F.least("near", "further").alias("next"), "root")
        step, newer = materialize(jumped, "labels")
        changed = step.where("next != root").limit(1).count()
        discard(spark, folder)
        labels, folder = step.select("x", F.col("next").alias("root")), newer
        if not changed:
            discard(spark, folder_of_links, folder_of_both)
            return labels, [folder]
    raise RuntimeError("components did not settle")


def too_busy(members: DataFrame, busy: DataFrame) -> DataFrame:
    """Members of long lists without the classes that can do without; ``share`` says how many signatures a shingle a class has in such lists.

    Partners share more signatures than the smaller of their two e. So a class leaves only if it has no more
    signatures in such lists than the e of its smallest partner, which has the least e of all in either scheme.
    """
    top = F.expr("shiftleft(1L, length(bin(nx))) - 1")
    least = F.ceil(4 * F.col("nx") / 5)
    need = F.floor((least + F.least(top, F.floor(5 * least / 4))) / 9) + 1
    stay = busy.groupBy("x").agg(F.sum("ny").alias("often"), F.max("nx").alias("nx")).where(F.col("often") > F.floor(need / 4) + 2).select("x", (F.col("often") / F.col("nx")).alias("share"))
    return members.join(stay, "x").select("list", "x", "nx", "share")


def buckets_for(size: int) -> int:
    """Buckets for so many bytes of text, as many as a task's number can name at most (64 PB of text)."""
    return min((1 << 31) - 1, max(16, -(-size // BUCKET)))


def jaccard_classes(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", n_buckets: int | None = None, small_list: int = 8) -> DataFrame:
    """Per row: doc_id, rid (hash of the text), n_shingles, component_id, leads (the row is its component's smallest doc_id)."""
    spark = docs.sparkSession
    n_buckets = n_buckets or buckets_for(docs.agg(F.sum(F.octet_length(text_column)).alias("size")).first().size or 0)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("rid"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    # Equal lists and pairs of different buckets are told apart later; the counts must not be.
    listed, listed_folder = materialize(match(sign(source, n_buckets), small_list, n_buckets), "listed")
    drawn = listed.where("sketch is not null").select("a", "n", "sketch")
    pairs, pairs_folder = materialize(listed.where("y is not null").select("x", "y").distinct(), "pairs")
    members, members_folder = materialize(too_busy(listed.where("list is not null and y is null").select("list", "x", "nx").distinct(), listed.where("list is null and x is not null").select("x", "nx", "ny")), "members")
    kept, _ = materialize(listed.where("n is not null").select("doc_id", "rid", "n", "a", "b"), "sets")
    classes = kept.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")).alias("place"))
    wanted, wanted_folder = materialize(members.select(F.col("x").alias("a")).union(pairs.select(F.explode(F.array("x", "y")).alias("a"))).distinct(), "wanted")
    drawn, drawn_folder = materialize(drawn.join(wanted, "a", "left_semi").dropDuplicates(["a"]), "sketches")
    discard(spark, listed_folder)

    key = F.xxhash64("doc_id", "rid")
    places, places_folder = materialize(classes.join(wanted, "a").select("a", "place.doc_id", "place.rid").withColumn("key", key), "places")
    # Only the texts of classes in a list travel, nearly: a filter of bounded size stands before the join.
    near = source.withColumn("key", key).where(may_hold(places, "key", places.count()))
    texts = near.join(places.select("a", "key", "rid", F.col("doc_id").alias("at_id")), ["key", "rid"]).where(F.col("doc_id").eqNullSafe(F.col("at_id")))
    texts, texts_folder = materialize(texts.groupBy("key", "rid").agg(F.first("a").alias("a"), F.first("text").alias("text")).select("a", "text"), "texts")
    discard(spark, places_folder)
    discard(spark, wanted_folder)

    links, link_folders = verify_all(pairs, members, texts, drawn)
    discard(spark, pairs_folder, members_folder, drawn_folder, texts_folder)
    roots, root_folders = components(links)
    named = classes.join(roots, classes.a == roots.x, "left").select("a", "b", "least", "place", F.coalesce("root", "a").alias("root"))
    # Classes without links are their own component.
    least = named.groupBy("root").agg(F.min("least").alias("component"), F.min("place").alias("first"))
    of_class, _ = materialize(named.join(least, "root").select("a", "b", "component", "first"), "components")
    discard(spark, *link_folders, *root_folders)
    joined = kept.join(of_class.withColumnRenamed("a", "ca").withColumnRenamed("b", "cb"), (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")), "left")
    leads = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("rid") == F.col("first.rid"))
    alone = F.col("n") == 0
    return joined.select("doc_id", "rid", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), (alone | leads).alias("leads"))


def keep_one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that lead their component (smallest doc_id), and those without shingles. Rows that repeat doc_id and text count once.

    Columns of any name may stand beside the two named ones; all travel in one struct.
    """
    leaders = jaccard_classes(docs, id_column=id_column, text_column=text_column).where("leads").select(F.col("doc_id").alias("lead_id"), F.col("rid").alias("lead_rid")).distinct()
    keyed = docs.select(F.col(id_column).cast("long").alias("key_id"), F.xxhash64(text_column).alias("key_rid"), F.struct("*").alias("row"))
    kept = keyed.join(leaders, F.col("key_id").eqNullSafe(F.col("lead_id")) & (F.col("key_rid") == F.col("lead_rid")), "left_semi")
    return kept.groupBy("key_id", "key_rid").agg(F.first("row").alias("row")).select("row.*")


def plausible(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """Pairs whose sketches don't rule out that they are similar enough."""
    one = drawn.select(F.col("a").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
    two = drawn.select(F.col("a").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
    both = pairs.join(two, "y").join(one, "x").select("x", "y", "nx", "ny", "sx", "sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for nx, ny, sx, sy in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                size = min(len(sx), len(sy))
                good.append(int(np.bitwise_count(folded(sx, size) ^ folded(sy, size)).sum()) * 9 <= nx + ny)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "x long, y long")


def parities(shingles: np.ndarray, cells: int) -> np.ndarray:
    """The set's parity sketch in so many cells, as 64-bit words."""
    at = mix(shingles, 7) & np.uint64(cells - 1)
    words = np.zeros(cells // 64, np.uint64)
    np.bitwise_xor.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return words


class _Piece:
    """Members of a hub's lists with their sets, and which of their components have been joined here."""

    def __init__(self) -> None:
        self.ids, self.n, self.roots, self.sets, self.words, self.up = [], [], [], [], None, {}

    def hold(self, ids: list[int], n: list[int], roots: list[int], texts: list[bytes]) -> None:
        self.ids += ids
        self.n += n
        self.roots += roots
        self.sets += shingle_sets(texts)

    def top(self, root: int) -> int:
        while (above := self.up.get(root, root)) != root:
            root = above
        return root

    def links(self, x: int, n: int, root: int, shingles: np.ndarray) -> list[int]:
        """Members that x is linked with, one for each component that it wasn't yet joined with."""
        if self.words is None:
            self.cells = max(256, 16 << int(max(self.n)).bit_length())
            self.words = np.stack([parities(s, self.cells) for s in self.sets])
            self.n, self.roots = np.array(self.n), np.array(self.roots)
        at = np.flatnonzero((self.roots != root) & compatible(self.n, np.int64(n)))
        if not len(at):
            return []
        words = self.words if len(at) == len(self.n) else self.words[at]
        differ = np.bitwise_count(words ^ parities(shingles, self.cells)).sum(axis=1, dtype=np.int64)
        likely = np.flatnonzero(differ * 9 <= self.n[at] + n)
        found = []
        for i in at[likely[np.argsort(differ[likely], kind="stable")]].tolist():
            a, b = self.top(root), self.top(int(self.roots[i]))
            if a != b and similar(self.sets[i], shingles):
                self.up[max(a, b)] = min(a, b)
                found.append(self.ids[i])
        return found


def links_in_lists(state: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (x, y) that join different components within the lists of one hub.

    ``state``: hub, x, nx, root, each pair of hub and x once. Members outside a hub's largest component are compared with all
    members, in pieces of about ``PIECE`` shingles that are held while the others stream by.
    Each piece gives at most one link fewer than it meets components.
    """
    by_root = state.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("nx").alias("shingles"))
    hubs = by_root.groupBy("hub").agg(F.max_by("root", F.struct("m", "root")).alias("largest"), F.ceil(F.sum("shingles") / PIECE).alias("pieces"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    known = state.join(hubs, "hub").join(texts.select(F.col("a").alias("x"), "text"), "x")
    columns = ["hub", "piece", "guest", "x", "nx", "root", "text"]
    held = known.withColumn("guest", F.lit(False)).withColumn("piece", F.pmod(F.xxhash64("x"), "pieces")).select(*columns)
    guests = known.where("root != largest").withColumn("guest", F.lit(True)).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).select(*columns)
    dealt = held.unionByName(guests).repartition("hub", "piece").sortWithinPartitions("hub", "piece", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, _Piece()
        for batch in batches:
            found_x, found_y = [], []
            hub, piece_, guest, x, n, root, text = (batch.column(i).to_pylist() for i in range(7))
            at = 0
            while at < len(x):
                key, end = (hub[at], piece_[at], guest[at]), at
                while end < len(x) and end < at + 256 and (hub[end], piece_[end], guest[end]) == key:
                    end += 1
                if key[:2] != now:
                    now, members = key[:2], _Piece()
                with np.errstate(over="ignore"):
                    if not key[2]:
                        members.hold(x[at:end], n[at:end], root[at:end], text[at:end])
                    elif members.ids:
                        for i, shingles in zip(range(at, end), shingle_sets(text[at:end]), strict=True):
                            ys = members.links(x[i], n[i], root[i], shingles)
                            found_x += [x[i]] * len(ys)
                            found_y += ys
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(found_x, pa.int64()), pa.array(found_y, pa.int64())], ["x", "y"])

    return dealt.mapInArrow(run, "x long, y long")


def verify_all(pairs: DataFrame, members: DataFrame, texts: DataFrame, drawn: DataFrame) -> tuple[DataFrame, list[str]]:
    """Links that connect what all candidate pairs would, and the folders that hold them.

    First the pairs of short lists, and each long list's hub with the others. Then, among members of a hub's
    lists that aren't one component, those of different components.
    """
    hubs = members.groupBy("list").agg(F.max(F.struct("share", "x", "nx")).alias("hub")).select("list", F.col("hub.x").alias("hub"), F.col("hub.nx").alias("hub_n"))
    around, around_folder = materialize(members.join(hubs, "list").where("hub != x").groupBy("hub", "hub_n", "x", "nx").agg(F.lit(1).alias("one")).drop("one"), "around")
    fits = 5 * F.least("hub_n", "nx") >= 4 * F.greatest("hub_n", "nx")
    stars = around.where(fits).select(F.col("hub").alias("x"), F.col("x").alias("y"))
    # A pair that stands in the list both ways round is verified once.
    both = pairs.union(stars).groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.max("x").alias("x")).select("x", F.when(F.col("x") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("y"))
    first, first_folder = materialize(plausible(both, drawn), "candidates")
    links, links_folder = materialize(verify(first, texts), "verified")
    discard(links.sparkSession, first_folder)
    if not around.limit(1).count():
        return links, [links_folder, around_folder]
    roots, root_folders = components(links)
    state = around.join(roots, "x", "left").select("hub", "x", "nx", F.coalesce("root", "x").alias("root"))
    state, state_folder = materialize(state, "open")
    second, second_folder = materialize(links_in_lists(state, texts), "verified")
    discard(links.sparkSession, state_folder, around_folder, *root_folders)
    return links.union(second), [links_folder, second_folder]


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
