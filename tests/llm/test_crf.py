import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import crf, line_quality, toxicity
from lexispark.llm.labelled import training_texts


def plain_marginals(u, t):
    """Sums over all label sequences of a chain."""
    weight = {(0, 0): 0.0, (0, 1): t[0], (1, 0): t[1], (1, 1): t[2]}
    total, ones = 0.0, np.zeros(len(u))
    for y in itertools.product((0, 1), repeat=len(u)):
        w = np.exp(sum(a * b for a, b in zip(u, y)) + sum(weight[p] for p in itertools.pairwise(y)))
        total += w
        ones += w * np.array(y)
    return ones / total


def test_forward_backward():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 7, 0, 5, 7])
    u, t = rng.normal(size=lengths.sum()) * 2, np.array([-1.0, 0.5, 1.5])
    got = crf.marginals(u, crf.Chains(lengths), t)
    at = 0
    for n in lengths:
        assert np.allclose(got[at : at + n], plain_marginals(u[at : at + n], t) if n else [])
        at += n


def test_fit_finds_runs():
    rng = np.random.default_rng(2)
    labels = np.concatenate([np.repeat(rng.integers(0, 2, 8), 5) for _ in range(30)])
    x = np.column_stack([labels * 2 - 1 + rng.normal(size=len(labels)) * 1.5, np.ones(len(labels))])
    w, t = crf.fit(x, labels, np.full(30, 40), 2)
    p = crf.marginals(x @ w, crf.Chains(np.full(30, 40)), t)
    alone = ((x[:, 0] > 0) == labels).mean()
    assert ((p > 0.5) == labels).mean() > alone + 0.08 and t[2] > t[0]


@pytest.mark.parametrize("seed", range(5))
def test_runs_of_plain_tokens_are_exact(seed):
    rng = np.random.default_rng(seed)
    u = np.where(rng.random(11) < 0.4, rng.normal(size=11) * 4, 0.0)
    model = toxicity.ToxicSpans({}, -1.5, np.array([-1.0, -0.7, 0.8]), None, 0.5)
    at, p = model.marginals(u)
    assert np.allclose(p, plain_marginals(u - 1.5, model.t)[at])


def test_toxic_spans():
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = ["w" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
        if i % 3 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["Grumble!", "snarkling", "snarkish,", "GRUMBLE"])
        rows.append((" ".join(words), int(i % 3 == 0)))
    model = toxicity.fit(rows[:240])
    assert all((model.score(text) >= 0.5) == bool(label) for text, label in rows[240:])
    text = "some  grumble\nthen snarky plain words"
    found = {("é " + text)[a:b] for a, b in model.spans("é " + text)}
    assert "grumble" in found and "plain" not in found
    for blank in ("", " \n"):
        assert 0 <= model.score(blank) < 0.5 and model.spans(blank) == []
    long = "plain " * 400_000 + "grumble grumble snarkish grumble"
    assert len(model.spans(long)) == 4


def test_toxicity_scores_by_brute_force():
    """A text's score from its tokens' weights, all label sequences, and the calibration, each worked out plainly."""
    rng = random.Random(8)
    weights = {"bad": 4.0, "bad1": 1.0, "bads*": 2.5, "snar*": 3.0, "nice": -1.5}
    model = toxicity.ToxicSpans(weights, -2.0, np.array([-0.5, 0.3, 1.2]), np.array([0.4, 0.7, -0.2, 1.5, -1.0]), 0.3)
    for _ in range(60):
        words = [rng.choice(["bad", "Bad!", "bad1", "badsy", "snarky", "nice", "x", "plain", "é", "--"]) for _ in range(rng.randrange(0, 9))]
        text = " ".join(w + rng.choice(["", " ", "\n"]) for w in words)
        tokens = text.split()
        u = []
        for token in tokens:
            word = token.lower().strip(toxicity.EDGES)
            names = {word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) >= k)} if word else set()
            u.append(sum(weights.get(n, 0.0) for n in names))
        p = plain_marginals(np.array(u) - 2.0, model.t) if tokens else np.zeros(0)
        p = p[np.array(u) != 0] if tokens else p
        top = max([-2.0, *(np.log(x / (1 - x)) for x in p)])
        facts = [top, np.log1p(p.sum()), np.log1p((p >= 0.5).sum()), np.log1p(len(tokens)) / 10]
        score = 1 / (1 + np.exp(-(np.dot(facts, model.calibration[:-1]) - 1.0)))
        assert abs(model.score(text) - score) < 1e-9
        marked = [i for i, x in enumerate(u) if x and plain_marginals(np.array(u) - 2.0, model.t)[i] >= 0.5]
        assert [text[a:b] for a, b in model.spans(text)] == [tokens[i] for i in marked]


def plain_line(line, lines):
    raw = line.encode()
    n = max(1, len(raw))
    shares = lambda chars: min(1.0, 10 * sum(raw.count(c) for c in chars.encode()) / (n + 10))
    capitals, small = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 or c >= 128 for c in raw)
    w = line.split()
    again = sum(a == b for a, b in zip(w, w[1:]))
    marks = [shares("0123456789"), shares("#$%&*+<=>@\\^_`{}~[]/"), shares("!"), shares("|"), shares(".,;:?")]
    return [capitals / (capitals + small + 20), *marks, again / (len(w) + 5), min(2.0, (capitals + small + 25) / (len(w) + 5) / 6), float(bool(w) and lines.count(line) > 1)]


def test_quality_scores_by_brute_force():
    """A text's score from its lines' features and those of their neighbours, all label sequences, lengths, and the calibration."""
    rng = random.Random(8)
    weights = np.random.default_rng(5).normal(size=3 * line_quality.N_OWN + 1)
    model = line_quality.LineQuality(weights, np.array([-0.5, 0.3, 1.2]), np.array([2.0, 1.5, -0.7]))
    texts = ["", "\n\n"] + ["\n".join(rng.choice(["Good line of words.", "$$$ 100% !!!", "a a a b", "| x | y |", "", "é É 12", "same", "same"]) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    got = model.scores(texts)
    for text, found in zip(texts, got, strict=True):
        lines = text.split("\n")
        own = [plain_line(x, lines) for x in lines]
        none = [0.0] * line_quality.N_OWN
        u = np.array([np.dot([*own[i], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none), 1.0], weights) for i in range(len(own))])
        size = np.array([max(1, len(x.encode())) for x in lines], float)
        q = float((plain_marginals(u, model.t) * size).sum() / size.sum())
        q = min(max(q, 1e-4), 1 - 1e-4)
        assert abs(found - 1 / (1 + np.exp(-(2.0 * q + 1.5 * np.log(q / (1 - q)) / 4 - 0.7)))) < 1e-9


def test_without_labels():
    assert toxicity.fit([]).score("a") == 0.5 and toxicity.fit([("a", 0)]).score("a") == 0.0
    assert line_quality.fit([("a", 1)]).scores(["a", ""]).tolist() == [0.5, 0.5]


def test_line_quality_and_cases(spark):
    rng = random.Random(6)

    def good():
        return "\n".join(" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(12)).capitalize() + "." for _ in range(rng.randrange(1, 9)))

    def bad():
        return "\n".join(" ".join("".join(rng.choices("abcdefghij", k=5)) + "$$$" for _ in range(12)) for _ in range(rng.randrange(1, 9)))

    rows = [((good(), 1) if i % 2 else (good().split("\n")[0] + "\n" + bad() + "\n" + bad(), 0)) for i in range(200)]
    model = line_quality.fit(rows[:150])
    assert all((s >= 0.3) == bool(y) for s, (_, y) in zip(model.scores([t for t, _ in rows[150:]]), rows[150:]))
    marginals, _, n = model.line_marginals([rows[0][0]])
    assert marginals[-1] < 0.5 and n[0] == len(marginals)
    assert model.line_marginals([rows[1][0]])[0].min() > 0.5
    texts = [(1, None, 5), (2, "", 5), (3, "\n\n", 5), (None, "a" * 300_000, 5), (4, bad(), 5), (4, good(), 5), (5, "é|" * 40_000, 5)]
    df = spark.createDataFrame([(i, t, s) for i, t, s in texts], "doc_id long, text string, score int")
    got = line_quality.score_quality(df, model).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    kept = line_quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.where("doc_id = 4").count() == 1
    assert line_quality.score_quality(df.limit(0), model).count() == 0 and line_quality.keep_good(df.limit(0), model).count() == 0
    toxic = toxicity.score_toxicity(df, toxicity.fit([("x bad1 y", 1), ("x z y", 0), ("bad1 q", 1), ("z q", 0)])).collect()
    assert len(toxic) == len(texts) and all(0 <= r.score <= 1 for r in toxic)


def test_chains_that_count_several_times():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(12, 2)), rng.integers(0, 2, 12)
    once = crf.fit(np.concatenate([x, x[6:], x[6:]]), np.concatenate([y, y[6:], y[6:]]), np.array([6] * 4), 2)
    often = crf.fit(x, y, np.array([6, 6]), 2, times=np.array([1, 3]))
    assert np.allclose(once[0], often[0]) and np.allclose(once[1], often[1])


def test_training_rows(spark):
    """Held-out rows are never collected; rows and bytes of a sample are bounded; nulls and repeated rows do no harm."""
    docs = spark.createDataFrame([(i, f"text {i} " + "x" * (i % 7), "clash") for i in range(200)] + [(None, "none", "c"), (3, None, "c")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (4, None), (8, 0), (10**6, 1)], "doc_id long, quality int")
    out = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    rows = training_texts(docs, labels, "quality", {1: 1000, 0: 1000})
    ids = {int(text.split()[1]) for text, _ in rows if text}
    assert ids == set(range(200)) - out and all(label == int(text.split()[1]) % 2 for text, label in rows if text)
    assert len(training_texts(docs, labels, "quality", {1: 5, 0: 7})) in (12, 13)
    some = training_texts(docs, labels, "quality", {1: 1000, 0: 1000}, most_bytes=300)
    assert 300 <= sum(len(text) for text, _ in some) <= 320
    long = docs.where("doc_id < 200").withColumn("text", F.when(F.col("doc_id") == min(ids), F.repeat(F.lit("long "), 10_000)).otherwise(F.col("text")))
    whole = training_texts(long, labels, "quality", {1: 1000, 0: 1000}, most_bytes=45_000)
    assert max(len(text) for text, _ in whole) == 50_000
    assert training_texts(docs.limit(0), labels, "quality", {1: 5}) == [] == training_texts(docs, labels.limit(0), "quality", {1: 5})


def test_queries_keep_their_contract(spark, tmp_path):
    """One row a document; a held-out document's label changes no score; scores follow the text alone."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(120):
        toxic, bad = i % 3 == 0, i % 4 == 0
        words = ["w" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(30)]
        if toxic:
            words[5] = words[11] = "grumble"
        docs.append((i, "\n".join(" ".join(words[k : k + 10]) + (" $$$$ !!! ####" if bad else ".") for k in (0, 10, 20)), "en", "s"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(500, None, None, None), (501, "", "", ""), (502, docs[0][1], "xx", "other"), (None, "a b", "en", "s")]
    for flip in (False, True):
        rows = [(i, 1 - q, 1 - t) if flip and zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/{flip}/documents.parquet")
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{flip}/labels.parquet")
    for query, column, limit in ((toxicity.op2_toxicity_crf, 2, 0.5), (line_quality.op10_quality_crf, 1, 0.3)):
        one, two = ({r.doc_id: r for r in query(spark, f"{tmp_path}/{flip}").collect()} for flip in (False, True))
        assert one.keys() == {r[0] for r in docs} and all(one[i].score == two[i].score for i in one)
        assert all(r.predicted == int(r.score >= limit) and 0 <= r.score <= 1 for r in one.values())
        assert all(r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 0) for i, r in one.items())
        assert one[502].score == one[0].score
        assert all(one[row[0]].predicted == row[column] for row in labels)
