import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import jaccard_join as jj


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(sets):
        least[top(i)].append(doc_id)
    return sorted(((i is None, i or 0), len(s), min((x for x in least[top(n)] if x is not None), default=None)) for n, (i, s) in enumerate(sets))


def got(df, **options):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in jj.jaccard_classes(df, **options).collect())


def corpus(seed, n_bases=6, copies=30, passage=0):
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(4000)}"
    shared = [word() for _ in range(passage)]
    for _ in range(n_bases):
        base = [word() for _ in range(rng.choice([3, 5, 6, 9, 14, 40, 150]))]
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(text) // 12)):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(shared + text).upper() if rng.random() < 0.2 else "\n".join(shared + text)))
    return rows


@given(st.integers(1, 400), st.integers(0, 100), st.randoms(use_true_random=False))
@settings(max_examples=150, deadline=None)
def test_similar_sets_share_signatures_beyond_the_spare_ones(n, percent, rng):
    """Sets at exactly the threshold, or above it, share more than e signatures."""
    common = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
    differ = n // 4 * percent // 100
    left = rng.randrange(differ + 1)
    fresh = np.array([rng.getrandbits(64) for _ in range(differ)], np.uint64)
    a, b = np.unique(np.concatenate([common, fresh[:left]])), np.unique(np.concatenate([common, fresh[left:]]))
    if 5 * n < 4 * (n + differ):
        return
    with np.errstate(over="ignore"):
        who, sig = jj.signatures([a, b])
    both = set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())
    assert both
    need = [(len(x) + min(2 ** int(len(x)).bit_length() - 1, 5 * len(x) // 4)) // 9 + 1 for x in (a, b)]
    room = [int(jj.partitions_of(jj.band_of(np.array([len(x)])))[0]) - k for x, k in zip((a, b), need)]
    if min(room) >= max(jj.spare(k) for k in need):
        assert len(both) > min(jj.spare(k) for k in need)
    # What lets a class leave long lists: the least e that any partner of either can have.
    assert len(both) > max(least_spare(len(a)), least_spare(len(b)))


def least_spare(n):
    least = -(-4 * n // 5)
    return jj.spare((least + min(2 ** least.bit_length() - 1, 5 * least // 4)) // 9 + 1)


def test_least_spare_of_all_partners():
    """No partner has fewer spare signatures, in its own band's scheme or the next one."""
    for n in range(1, 700):
        for m in range(-(-4 * n // 5), 5 * n // 4 + 1):
            top, largest = 2 ** m.bit_length() - 1, 5 * m // 4
            assert jj.spare((m + min(top, largest)) // 9 + 1) >= least_spare(n)
            assert largest <= top or jj.spare((m + largest) // 9 + 1) >= least_spare(n)


def test_set_within_a_larger_one_when_all_shared_lists_are_long(spark):
    """36 shingles within 45: ten of them stand in eight other texts, so that every list that both are in is long."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    for _ in range(2):
        small = [word() for _ in range(40)]
        rows = [(1, " ".join(small)), (2, " ".join([*small, *(word() for _ in range(9))]))]
        for i in range(8):
            start = rng.randrange(27)
            rows.append((3 + i, " ".join([*(word() for _ in range(13)), *small[start : start + 14], *(word() for _ in range(14))])))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(df, small_list=2) == got(df) == plain(rows)


def test_pieces_of_long_lists(spark, monkeypatch):
    """Several pieces and components in a hub's lists."""
    monkeypatch.setattr(jj, "PIECE", 100)
    rows = corpus(23, n_bases=3, copies=60, passage=10)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), small_list=2) == plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = corpus(seed, passage=0 if seed else 30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == plain(rows)


def test_long_lists_and_contraction(spark, monkeypatch):
    monkeypatch.setattr(jj, "CONTRACTED", 10)
    rows = corpus(11, n_bases=3, copies=40, passage=12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, small_list=2, n_buckets=3) == plain(rows)
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "x long, y long")
    assert {r.x: r.root for r in jj.components(links, contract_links=10)[0].collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("seed", range(4))
def test_larger_partner_of_many_short_copies(spark, seed):
    """A set with more spare signatures than its partners stays in the lists of those it shares with them."""
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(13)]
        copies = [[*base, f"v{rng.randrange(10**6)}"] for _ in range(12)]
        copies.append([*copies[rng.randrange(12)], "x1", "x2"])
        rows += [(len(rows) + i, " ".join(words)) for i, words in enumerate(copies)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (6, "b a"), (6, "b a"), (None, "x y z"), (None, "x y z"), (9, "x Y z"), (10, "word " * 20_000), (11, "word word word word word"), (12, "é b")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, bucket string")
    assert got(df) == plain(rows)
    kept = jj.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text and r.text.strip()) == [(4, "a b"), (6, "b a"), (9, "x Y z"), (10, "word " * 20_000), (12, "é b")]
    assert jj.jaccard_classes(df.limit(0)).count() == 0


def test_buckets_follow_the_input():
    """Beyond 2 TB of text too, and a signature's bucket and lower bytes tell it apart."""
    assert jj.buckets_for(0) == 16 and jj.buckets_for(100 << 40) == (100 << 40) // jj.BUCKET > 1 << 21
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 2**64, 200_000, dtype=np.uint64)
    for n in (16, 1000, 3_276_800, 2**31 - 1):
        bucket = jj.bucket_of(sig, n)
        assert bucket.min() >= 0 and bucket.max() < n and len(np.unique(bucket)) > 0.9 * min(n, len(sig)) * (1 - np.exp(-len(sig) / n)) / min(1, len(sig) / n)
    assert (jj.bucket_of(np.sort(sig), 1 << 20)[1:] >= jj.bucket_of(np.sort(sig), 1 << 20)[:-1]).all()
