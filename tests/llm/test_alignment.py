import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexispark.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPECIAL = ["", " ", "\n", "  a  ", "a \nb\t c\n\n d ", "<|endoftext|> <s> <0x41></s><unk>", "naïve Straße İ 日本語　テスト x y\xa0z\x85w v", "emoji 😀 👩‍👩‍👧", "a▁b", "a\x00b \x1c c", "x" * 3000, " \r\n it's don't 'll 12345 ...!?", "é ﬁ ½"]


class Plain:
    """Whole texts, one at a time, and all links in one place."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        alphabet = al.byte_alphabet()
        self.bytes_a = {i: bytes(alphabet.get(c, 0) for c in t) for t, i in self.a.get_vocab().items()}

    def tokens(self, text):
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        of_a = [self.bytes_a[i] for i in a]
        of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in b)]
        raw = (" " + text).encode()
        if b"".join(of_a) != raw or b"".join(of_b) != raw:
            return [], []
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        return list(zip(a, ends(of_a), strict=True)), list(zip(b, ends(of_b), strict=True))

    def groups(self, text):
        a, b = self.tokens(text)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        out = [([], []) for _ in cuts]
        for side, tokens in enumerate((a, b)):
            for i, e in tokens:
                out[bisect.bisect_left(cuts, e)][side].append(i)
        return len(a), len(b), out

    def result(self, texts):
        found = [self.groups(t) for t in texts]
        n = Counter((a[-1], b[-1]) for *_, groups in found for a, b in groups)
        best = defaultdict(int)
        for (_, b), count in n.items():
            best[b] = max(best[b], count)
        rows = []
        for n_a, n_b, groups in found:
            links = [(a[-1], b[-1]) for a, b in groups]
            text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
            rows.append((n_a, n_b, len(groups), len(links), sum(n[x] == best[x[1]] for x in links), sum(n[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
        return rows, n


def test_byte_alphabet():
    alphabet = al.byte_alphabet()
    assert sorted(alphabet.values()) == list(range(256)) and alphabet["Ġ"] == 32 and alphabet["Ċ"] == 10 and alphabet["A"] == 65


@given(st.text(st.sampled_from("aB é\n\t\r\x1c\x85\xa0 　▁<|>'s1.日😀́"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_cut_texts_equal_whole_ones(text):
    aligner, plain = al.aligner_of(A, B), PLAIN
    n_a, n_b, groups = plain.groups(text)
    if not text:
        return
    units = aligner.units_of(text)
    split, first = al.split_units(["x y", text])
    assert "".join(units) == " " + text and split.to_pylist()[int(first[1]) :] == units
    found = aligner.align(units)
    if all(u.ok for u in found):
        whole = [tuple(map(tuple, g)) for g in groups]
        parts = [tuple(tuple(map(int, side.split(","))) for side in g.split("|")) for u in found for g in u.groups[:-1].split(";")]
        assert parts == whole and sum(u.n_a for u in found) == n_a and sum(u.n_b for u in found) == n_b
    else:
        assert (n_a, n_b, groups) == (0, 0, [])


PLAIN = Plain()


def corpus():
    rng = random.Random(3)
    words = ["the", "Anou", "naïve", "x1", "entscheidung", "é", "token's", "\n", "foo.\nBar", "▁"]
    texts = [*SPECIAL, None, "same text here", "same text here", " ".join(rng.choices(words[:9], k=30_000))]
    texts += [" ".join(rng.choices(words, weights=[9] * 9 + [1], k=rng.randrange(1, 40))) for _ in range(60)]
    ids = [*range(len(texts) - 3), 5, 5, None]
    return [(i, t, "clash", 1.5) for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize(("block_bytes", "stripe_rows"), [(8 << 20, 4096), (300, 3)])
def test_equals_brute_force(spark, block_bytes, stripe_rows):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, best double").repartition(3)
    aligned = al.align(df, A, B, block_bytes=block_bytes, stripe_rows=stripe_rows, stripes=7)
    assert (aligned.salts > 1) == (stripe_rows == 3)
    counts = al.pair_counts(aligned)
    expected, n = PLAIN.result([t for _, t, *_ in rows])
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    got = al.score(aligned, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], *e) for r, e in zip(rows, expected, strict=True)), key=key)
    best = defaultdict(int)
    for (_, b), count in n.items():
        best[b] = max(best[b], count)
    assert {(r.b_id, r.a_id, r.n_links) for r in al.best_matches(counts).collect()} == {(b, a, c) for (a, b), c in n.items() if c == best[b]}
    aligned.discard()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    aligned = al.align(df, A, B)
    assert al.score(aligned, al.pair_counts(aligned)).count() == 0
    only = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    aligned = al.align(only, A, B)
    assert sorted(al.score(aligned, al.pair_counts(aligned)).collect(), key=str) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]
