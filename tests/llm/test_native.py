"""Mixture, sharding and decontamination against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexispark.llm import decontaminate as dc
from lexispark.llm import minimax_shards as ms
from lexispark.llm import mix_sources as mx


def texts(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "ç", None, "d"]), " ".join("w" * rng.randrange(1, 5) for _ in range(int(rng.paretovariate(0.8) * 3) % 900))) for i in range(n)]
    return [*rows, (n, "a", None), (n + 1, "b", ""), (n + 2, "zero", ""), (0, *rows[0][1:])]


def water(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(2))
def test_mixture(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mx.mix_sources(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += size(t)
    targets, taken, ideal = water(sizes), Counter(), Counter()
    for r in got:
        assert abs(r.target - targets[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        ideal[r.source] += r.rate * r.size
    for s, t in targets.items():
        assert abs(ideal[s] - t) <= 1e-5 * max(1, t)
        assert abs(taken[s] - t) <= 12
    by_source = defaultdict(list)
    for r in got:
        if r.size and 1e-9 < r.rate < 3:
            by_source[r.source].append(math.log(r.rate) / r.size)
    for slopes in by_source.values():  # an exponential tilt: one multiplier a source
        assert max(slopes) - min(slopes) < 1e-6
    again = mx.mix_sources(df.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.size, r.copies, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    repeated = mx.repeat_to_mix(df)
    assert repeated.columns == df.columns and repeated.count() == sum(r.copies for r in got)


def test_many_sizes_in_a_source(spark):
    """More sizes than a block of the fold."""
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * i) for i in range(2600)], "doc_id long, source string, text string")
    got = mx.mix_sources(df).collect()
    for source in "ab":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 12


def test_empty_mixture(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mx.mix_sources(df).count() == 0


def test_shards(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["same text", "x" * rng.randrange(400), f"é{i}" * rng.randrange(1, 60)])) for i in range(500)] + [(None, None), (7, ""), (7, "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, cell string")
    got = ms.shard_minimax(df, 24, piece_rows=16).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, bytes_, of_text = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
        of_text[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(0 <= s < 24 for s in slots)
    assert all(len(x) == 1 for x in of_text.values())
    assert ms.shard_minimax(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_capacity_is_the_least(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 50) for _ in range(rng.randrange(1, 60))]
    k = rng.randrange(1, 9)

    def shards(capacity):
        n, now = 1, 0
        for s in sizes:
            if now + s > capacity:
                n, now = n + 1, 0
            now += s
        return n

    least = next(c for c in range(max(sizes), sum(sizes) + 1) if shards(c) <= k)
    df = spark.createDataFrame([(10 * i, s) for i, s in enumerate(sizes)], "cell int, bytes long")
    capacity, cuts = ms.plan_cuts(df, k)
    assert capacity == least
    starts = [0, *(c // 10 for c in cuts), len(sizes)]
    assert len(starts) - 1 <= k and all(sum(sizes[a:b]) <= least for a, b in zip(starts, starts[1:]))


def least_capacity(sizes, k):
    def shards(capacity):
        n, now = 1, 0
        for s in sizes:
            if now + s > capacity:
                n, now = n + 1, 0
            now += s
        return n

    lo, hi = max([*sizes, -(-sum(sizes) // k)]), sum(sizes)
    while lo < hi:
        lo, hi = (lo, (lo + hi) // 2) if shards((lo + hi) // 2) <= k else ((lo + hi) // 2 + 1, hi)
    return lo


@pytest.mark.parametrize("seed", range(2))
def test_capacity_is_the_least_for_groups(spark, seed):
    """Many groups in a cell: only those around cuts are told apart, and the capacity is still that of single groups."""
    rng = random.Random(seed)
    groups = {rng.getrandbits(64) - 2**63: rng.choice([9, 40, rng.randrange(9, 900)]) for _ in range(800)}
    rows = spark.createDataFrame([(key, size) for key, size in groups.items() for _ in range(rng.randrange(1, 3))], "text_key long, size long")
    sizes = Counter()
    for r in rows.collect():
        sizes[r.text_key] += r.size
    ordered = sorted(sizes)
    capacity, cuts, cells = ms.plan_groups(rows, 7, top=60, step=2)
    assert cells.count() <= 16 and capacity == least_capacity([sizes[k] for k in ordered], 7)
    shard_bytes = Counter()
    for key in ordered:
        shard_bytes[sum(key >= c for c in cuts)] += sizes[key]
    assert len(shard_bytes) <= 7 and max(shard_bytes.values()) <= capacity


def test_hot_size_in_a_large_plan(spark, monkeypatch):
    """A plan too large to broadcast deals the rows of one size over several tasks, with the same result."""
    rows = [*texts(3, 60), *((1000 + i, "a", "three words here") for i in range(90))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    key = lambda r: (r.doc_id or 0, r.size, r.copies, r.taken)
    once = sorted(map(key, mx.mix_sources(df, piece_rows=16).collect()))
    monkeypatch.setattr(mx, "HELD", 0)
    monkeypatch.setattr(mx, "DEALT", 10)
    assert sorted(map(key, mx.mix_sources(df, piece_rows=16).collect())) == once


def test_names_may_clash(spark):
    names = ["mix_id", "mix_key", "copies", "row", "key", "key_id", "bad_id", "bad_key", "size", "source_key"]
    df = spark.createDataFrame([(1, "a", "b c d", *range(10)), (None, None, None, *range(10)), (2, "a", "x y z", *range(10))], f"doc_id long, source string, text string, {', '.join(f'{n} int' for n in names)}")
    bench = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    clean = dc.keep_uncontaminated(df, bench)
    assert clean.columns == df.columns and sorted((r.doc_id or 0, r.bad_key) for r in clean.collect()) == [(0, 7), (2, 7)]
    mixed = mx.repeat_to_mix(df)
    assert mixed.columns == df.columns and all(tuple(r)[3:] == tuple(range(10)) for r in mixed.collect())
    assert mx.mix_sources(df).count() == ms.shard_minimax(df).count() == 3


def plain_hits(text, items, window=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words, hit, found = re.findall(pattern, low(text)), set(), set()
    for item_id, item in items:
        w = re.findall(pattern, low(item))
        for s in range(max(0, len(w) - window) + 1 if w else 0):
            part = w[s : s + window]
            for at in range(len(words) - len(part) + 1):
                if words[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    found.add(str(item_id))
    return len(words), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "É", "é", "x1", "ab", "Zz", "q"])
    items = [(i, rng.choice([" ", ", "]).join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 13, 20, 40])] + [(90, None), (91, "--"), (92, "the end the end the end the end the end the end the end"), (10, "une deux trois quatre")]
    rows = [(None, None), (1, ""), (2, "!?"), (3, "THE"), (3, "THE")]
    for i in range(60):
        parts = [word() for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(items)[1] or "")
        rows.append((10 + i, (" " if i % 3 else "-\n").join(parts)))
    rows.append((99, "padding " * 5000 + items[5][1]))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (32 << 20, 0):
        got = dc.decontaminate(df, bench, broadcast_bytes=limit).collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got) == sorted(((i is None, i or 0), *plain_hits(t, items)) for i, t in rows)
    clean = dc.keep_uncontaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not plain_hits(t, items)[3] for _, t in rows)
    assert dc.decontaminate(df.limit(0), bench).count() == 0
    assert dc.decontaminate(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_multipliers_that_do_not_settle_are_an_error(spark, monkeypatch):
    rows = [(i, f"s{i % 3}", "w " * (1 + i * i % 97)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    whole = mx.balance
    # One Newton step, and halvings only from then on.
    monkeypatch.setattr(mx, "balance", lambda h, s, cap: whole(h, s, cap, tolerance=1e-3, most_steps=8))
    settled = {r.doc_id: r.taken for r in mx.mix_sources(df).collect()}
    assert len(settled) == 300
    monkeypatch.setattr(mx, "balance", lambda h, s, cap: whole(h, s, cap, tolerance=1e-15, most_steps=1))
    with pytest.raises(RuntimeError, match="off by"):
        mx.mix_sources(df).collect()


def test_equal_windows_are_one(spark):
    """A text of one word, and items that share all their windows: no row for each pair of them."""
    items = [(i, "a " * 40) for i in range(20)] + [(100 + i, "q w e r t z u i o p l k j") for i in range(200)] + [(400, "a " * 13 + "b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(0, "a " * 3000)] + [(1 + i, "q w e r t z u i o p l k j") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dc.benchmark_windows(bench, 13, "item_id", "text").count() == 3
    for limit in (32 << 20, 0):
        places = dc.find_places(df, bench, broadcast_bytes=limit)
        assert places.rows.where("length is not null").count() == 3000 - 12 + 100 and places.owners.count() == 3
        got = {r.doc_id: r for r in dc.decontaminate(df, bench, broadcast_bytes=limit).collect()}
        assert got[0].n_hit == 3000 and got[0]["items"] == sorted(map(str, [*range(20), 400]))
        assert all(got[i].n_hit == 13 and got[i]["items"] == sorted(str(100 + k) for k in range(200)) for i in range(1, 101))


def test_items_without_an_id(spark):
    """Their windows hit words, but there is no id to list; documents without words keep a row each."""
    df = spark.createDataFrame([(1, "x a b c y"), (1, "x a b c y"), (2, None), (None, ""), (3, ", !")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "A b c"), (None, "b")], "item_id long, text string")
    for limit in (32 << 20, 0):
        got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"], r.contaminated) for r in dc.decontaminate(df, bench, broadcast_bytes=limit).collect())
        assert got == [(0, 0, 0, [], False), (1, 5, 3, [], True), (1, 5, 3, [], True), (2, 0, 0, [], False), (3, 0, 0, [], False)]


def test_no_python_in_native_plans(spark):
    df = spark.createDataFrame([(1, "a", "b c d e f")], "doc_id long, source string, text string").select("doc_id", "source", F.col("text"))
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    for out in (mx.mix_sources(df), ms.shard_minimax(df), dc.decontaminate(df, bench)):
        assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
