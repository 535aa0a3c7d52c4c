import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexispark.llm import packing as pk
from lexispark.llm.token_files import default_tokenizer

sizes = st.lists(st.one_of(st.integers(1, 40), st.sampled_from([1, 7, 8, 15, 16, 16, 9])), max_size=80)


def whole(windows, capacity, docs):
    """Each id is in one piece, no window is too large, and none needs padding."""
    seen = defaultdict(list)
    for window in windows:
        fill = sum(len(p[2]) for p in window)
        assert 0 < fill <= capacity and pk.padded(fill, capacity) == fill
        for doc, start, ids, total in window:
            assert total == len(docs[doc]) and len(ids)
            seen[doc].append((start, ids.tolist()))
    for doc, ids in enumerate(docs):
        at, got = 0, []
        for start, part in sorted(seen[doc]):
            assert start == at
            at, got = at + len(part), got + part
        assert got == ids.tolist()


@given(sizes, st.sampled_from([1, 3, 1000]))
@settings(max_examples=200, deadline=None)
def test_all_ids_once(lengths, most_open):
    docs = [np.arange(i * 100, i * 100 + n, dtype="<u2") for i, n in enumerate(lengths)]
    packer = pk.SumOfSquares(16, most_open)
    done = []
    for i, ids in enumerate(docs):
        done += packer.add(i, ids)
        assert packer.n_open == packer.levels.sum() == sum(map(len, packer.windows)) <= most_open
        assert all(len(w) == n for w, n in zip(packer.windows, packer.levels, strict=True)) and packer.levels[0] == packer.levels[16] == 0
    whole(done + packer.settle(), 16, docs)
    assert packer.n_open == 0 and not packer.levels.any() and packer.settle() == []


@given(sizes)
@settings(max_examples=200, deadline=None)
def test_each_choice_has_the_least_sum_of_squares(lengths):
    """Against trying every level, with no bound on open windows."""
    packer = pk.SumOfSquares(16, 10**9)
    for size in (1 + n % 16 for n in lengths):
        before = packer.levels.copy()
        best = None
        for level in range(16 - size + 1):
            if level == 0 or before[level]:
                after = before.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 16
                best = min(x for x in (best, int((after**2).sum())) if x is not None)
        packer.add(0, np.zeros(size, "<u2"))
        assert (packer.levels**2).sum() == best


def test_many_equal_sizes_stay_bounded():
    """No two documents of this size share a window, so cuts keep the number of open windows at its bound."""
    docs = [np.full(10, i, "<u2") for i in range(3000)]
    packer, done = pk.SumOfSquares(16, 20), []
    for i, ids in enumerate(docs):
        done += packer.add(i, ids)
        assert packer.n_open <= 20
    whole(done + packer.settle(), 16, docs)


def test_bad_bounds():
    with pytest.raises(ValueError):
        pk.SumOfSquares(1)
    with pytest.raises(ValueError):
        pk.SumOfSquares(16, 0)


def test_documents(spark):
    rng = random.Random(5)
    words = ["the", "Anou", "é", "<|endoftext|>", "x1"]
    rows = [(i, rng.choice([None, "", " ", "same text", " ".join(rng.choices(words, k=rng.randrange(1, 900)))]), "clash", i) for i in range(120)]
    rows += [(500, " ".join(rng.choices(words, k=40_000)), "", 0), (777, "again", "", 0), (777, "again", "", 0), (None, "nobody", "", 0), (None, None, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, start long").repartition(3)
    plain = Tokenizer.from_file(default_tokenizer())
    expected = sorted((i is None, i or 0, *plain.encode(t or "", add_special_tokens=False).ids, 2) for i, t, *_ in rows)
    windows = pk.pack_documents(df, default_tokenizer(), most_open=5).cache()
    held = {w.sequence_id: w for w in windows.collect()}
    assert all(w.fill == len(w.ids) // w.width and w.size == pk.padded(w.fill) == w.fill <= 4096 for w in held.values())
    pieces = pk.pieces_of(windows).collect()
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for p in pieces:
        w = held[p.sequence_id]
        ids = np.frombuffer(w.ids, f"<u{w.width}")[p.offset : p.offset + p.length]
        assert p.length > 0 and len(ids) == p.length and zlib.crc32(ids.astype("<u4").tobytes()) == p.ids_crc32
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_document[p.doc_id].append((p.start, p.doc_tokens, ids.tolist()))
    for s, spans in by_sequence.items():
        spans.sort()
        assert [a for a, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) == held[s].fill
    single = [(i is None, i or 0, *(x for _, _, ids in sorted(parts) for x in ids)) for i, parts in by_document.items() if i not in (777, None)]
    assert sorted(single) == [e for e in expected if not e[0] and e[1] != 777]
    assert sum(p.length for p in pieces if p.doc_id == 777) == 4 and {p.doc_tokens for p in pieces if p.doc_id == 777} == {2}
    assert pk.pieces_of(pk.pack_documents(df.limit(0), default_tokenizer())).count() == 0
