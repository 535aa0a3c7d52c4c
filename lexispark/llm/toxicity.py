"""Toxic spans from a linear-chain conditional random field over tokens.

Tokens are labelled from the documents' labels: markers (words, or word beginnings of four to
six letters) are chosen one after another, each the one that explains most toxic documents not
yet explained, less what it costs among clean ones; the marked tokens of toxic documents are labelled toxic, all
others clean; so are words as telling as those. The field's features are words and word beginnings with enough support on either
side, plus 1; it learns their weights and the transitions from these tokens.

At scoring most tokens carry no feature but the constant. A run of such tokens is a
power of one 2 x 2 matrix, so forward-backward visits only the tokens with features and is still exact
for whole texts of any length. The marginals' largest and their sum become the document's score
by a calibrated logistic function; tokens with a marginal of 0.5 or more are the spans, as code point offsets.

Fitted on at most ``most_toxic`` and ``most_clean`` labelled documents in the order of a hash, up to the one that brings them to ``most_bytes``, none of them held out. All
their tokens count; training chains without features are alike, so those of one length are one chain that counts as often.

Cases: null, empty and blank texts have no tokens and get the score of a text with one plain
token. Without labelled documents of both classes, or without markers, scores are the share of toxic ones.
Rows that repeat get equal scores. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .labelled import held_out, training_texts
from .line_quality import blocks
from .shared import documents

BEGINNINGS = (4, 5, 6)
#: Characters of a text that are split together, cached words, and tokens of a training chain.
STRETCH, CACHED, CHAIN = 1 << 20, 300_000, 64
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
TOKEN = re.compile(r"\S+")


def names(token: str) -> list[str]:
    """Feature names of a token: the word without marks around it in small letters, and its beginnings."""
    word = token.lower().strip(EDGES)
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k or len(word) == k)] if word else []


class _Potentials(dict):
    """Token to the sum of its features' weights, worked out once a token."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        value = sum(self.weights.get(name, 0.0) for name in names(token))
        if len(self) > CACHED:
            self.clear()
        self[token] = value
        return value


@dataclass
class ToxicSpans:
    weights: dict[str, float]
    constant: float
    t: np.ndarray
    calibration: np.ndarray | None
    base_rate: float
    cache: _Potentials | None = field(default=None, repr=False)
    powers: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": None, "powers": None}

    def potentials(self, text: str) -> np.ndarray:
        if self.cache is None:
            self.cache = _Potentials(self.weights)
        out, at = [], 0
        while at < len(text):
            stop = at + STRETCH
            while stop < len(text) and not text[stop].isspace():
                stop += 1
            tokens = text[at:stop].split()
            out.append(np.fromiter(map(self.cache.__getitem__, tokens), float, len(tokens)))
            at = stop
        return np.concatenate(out) if out else np.zeros(0)

    def _steps(self, runs: np.ndarray) -> np.ndarray:
        """For each run of plain tokens, the matrix that carries a message across: [from, to], scaled."""
        if self.powers is None:
            plain = np.array([[1.0, np.exp(self.t[0] + self.constant)], [np.exp(self.t[1]), np.exp(self.t[2] + self.constant)]])
            values, vectors = np.linalg.eig(plain)
            values, vectors = values.real, vectors.real
            self.powers = vectors, values / np.abs(values).max(), np.linalg.inv(vectors)
        vectors, values, back = self.powers
        return np.maximum(np.einsum("ij,nj,jk->nik", vectors, values[None, :] ** runs[:, None], back), 1e-300)

    def marginals(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens with features, and the probability of each to be toxic given the whole text."""
        at = np.flatnonzero(u)
        if not len(at):
            return at, np.zeros(0)
        t, c = self.t, self.constant
        runs = np.diff(at, prepend=-1) - 1
        steps = self._steps(np.concatenate([runs, [len(u) - 1 - at[-1]]]))
        own = u[at] + c
        forward, message = [], None
        for i in range(len(at)):
            if message is None:
                if runs[i]:
                    a = np.array([1.0, np.exp(c)]) @ self._steps(np.array([runs[i] - 1]))[0]
                    x = np.log(a[1]) - np.log(a[0])
                    message = crf._pass(x, t[0], t[2], 0.0, t[1])
                else:
                    message = 0.0
            else:
                a = np.array([1 / (1 + np.exp(message)), 1 / (1 + np.exp(-message))]) @ steps[i]
                message = crf._pass(np.log(a[1]) - np.log(a[0]), t[0], t[2], 0.0, t[1])
            message = float(np.clip(message + own[i], -500, 500))
            forward.append(message)
        backward, b = [0.0] * len(at), None
        for i in range(len(at) - 1, -1, -1):
            tail = np.ones(2) if b is None else self._into(own[i + 1] + b)
            tail = steps[i + 1] @ tail
            b = float(np.log(tail[1]) - np.log(tail[0]))
            backward[i] = b
        return at, crf.sigmoid(np.array(forward) + np.array(backward))

    def _into(self, x: float) -> np.ndarray:
        """Backward message of the token before one with log odds x, scaled."""
        t = self.t
        v = np.array([np.logaddexp(0.0, t[0] + x), np.logaddexp(t[1], t[2] + x)])
        return np.exp(v - v.max())

    def summary(self, text: str) -> tuple[float, float, float, float]:
        """The largest marginal, as log odds; the logs of 1 plus their sum, and plus those of 0.5 or more; the log of the text's length."""
        u = self.potentials(text)
        return self._summed(len(u), self.marginals(u)[1])

    def _summed(self, n_tokens: int, p: np.ndarray) -> tuple[float, float, float, float]:
        length = float(np.log1p(n_tokens)) / 10
        if not len(p):
            return self.floor(), 0.0, 0.0, length
        top = min(float(p.max()), 1 - 1e-9)
        return max(self.floor(), np.log(max(top, 1e-9)) - np.log1p(-top)), float(np.log1p(p.sum())), float(np.log1p((p >= 0.5).sum())), length

    def floor(self) -> float:
        return max(-20.7, min(0.0, self.constant))

    def read(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """The text's score and its toxic spans, from one forward-backward pass."""
        u = self.potentials(text)
        at, p = self.marginals(u)
        score = self.base_rate if self.calibration is None else float(crf.sigmoid(np.dot(self._summed(len(u), p), self.calibration[:-1]) + self.calibration[-1]))
        wanted = set(at[p >= 0.5].tolist())
        return score, [(m.start(), m.end()) for i, m in enumerate(TOKEN.finditer(text)) if i in wanted] if wanted else []

    def score(self, text: str) -> float:
        return self.read(text)[0]

    def spans(self, text: str) -> list[tuple[int, int]]:
        return self.read(text)[1]


def feature_set(text: str) -> set[str]:
    return {name for token in set(text.split()) for name in names(token)}


def choose_markers(found: dict[str, set[int]], spread: Counter, n_toxic: int, n_clean: int, *, cost: float = 2.0, least: int = 2) -> list[str]:
    """Greedy cover of the toxic documents by features (each with the documents that have it) that are rare in clean ones."""
    ratio = n_toxic / max(1, n_clean)
    # A marker must stand out from chance: far more often in toxic documents than its share of all.
    found = {n: d for n, d in found.items() if len(d) >= max(least, 4 * spread[n] * ratio)}
    open_docs, markers = set(range(n_toxic)), []
    least_gain = max(least, 0.01 * n_toxic)
    while open_docs and found:
        name = max(found, key=lambda n: (len(found[n] & open_docs) - cost * spread[n] * ratio, len(n), n))
        if len(found[name] & open_docs) - cost * spread[name] * ratio < least_gain:
            break
        markers.append(name)
        open_docs -= found.pop(name)
        found = {n: d for n, d in found.items() if len(d & open_docs) >= least}
    return markers


class _Counts:
    """How many texts have a feature, at most: features that fall into one cell are counted together."""

    def __init__(self, cells: int = 1 << 22):
        self.cells = np.zeros(cells, np.int32)

    def at(self, names_of_text: set[str]) -> np.ndarray:
        return np.fromiter((hash(n) & (len(self.cells) - 1) for n in names_of_text), np.int64, len(names_of_text))

    def add(self, names_of_text: set[str]) -> None:
        np.add.at(self.cells, self.at(names_of_text), 1)


def fit(rows: list[tuple[str, int]]) -> ToxicSpans:
    """Texts are split anew in each pass, so that little is held besides them: features with enough support, and their toxic documents."""
    y = np.array([label for _, label in rows])
    rate = float(y.mean()) if len(y) else 0.5
    nothing = ToxicSpans({}, 0.0, np.zeros(3), None, rate)
    if len(set(y.tolist())) < 2:
        return nothing
    toxic, clean = [text for text, label in rows if label], [text for text, label in rows if not label]
    n1, n0, most, among = len(toxic), len(clean), _Counts(), Counter()
    # Neither a marker nor a kept feature has less support than this.
    support = max(2, min(0.01 * n1, max(4, 0.004 * n1)))
    for text in toxic:
        most.add(feature_set(text))
    for text in toxic:
        found = list(feature_set(text))
        among.update(itertools.compress(found, (most.cells[most.at(found)] >= support).tolist()))
    among = Counter({n: c for n, c in among.items() if c >= support})
    spread, held = Counter(), defaultdict(set)
    for text in clean:
        spread.update(feature_set(text) & among.keys())
    odds = {n: (c / n1) / ((spread[n] + 0.5) / n0) for n, c in among.items()}
    promising = {n for n in among if odds[n] >= 2}
    for i, text in enumerate(toxic):
        for name in feature_set(text) & promising:
            held[name].add(i)
    markers = choose_markers(held, spread, n1, n0)
    del held
    if not markers:
        return nothing
    kept = [n for n in sorted(promising, key=lambda n: (-odds[n] * among[n], n)) if odds[n] >= 6 and among[n] >= max(4, 0.004 * n1)]
    index = {n: i for i, n in enumerate(dict.fromkeys([*markers, *kept]))}
    # Markers explain the documents; what hardly ever occurs in clean ones is as toxic, though a marker explained its documents first.
    constant, marked = len(index), {index[n] for n in (*markers, *(n for n in kept if odds[n] >= 25 and among[n] >= max(5, 0.02 * n1)))}
    known: dict[str, list[int]] = {}
    none: list[int] = []
    # Chains of CHAIN tokens; those without any feature differ in length alone and are counted.
    at, of, labels, lengths, base, bare = array("l"), array("l"), array("b"), [], 0, Counter()
    for text, label in rows:
        tokens = text.split()
        for a in range(0, len(tokens), CHAIN):
            part = tokens[a : a + CHAIN]
            for token in part:
                if token not in known:
                    known[token] = [index[n] for n in names(token) if n in index] or none
            own = [known[token] for token in part]
            if not any(own):
                bare[len(part)] += 1
                continue
            for i, features in enumerate(own):
                at.extend([base + i] * (len(features) + 1))
                of.extend(features)
                of.append(constant)
                labels.append(int(bool(label) and not marked.isdisjoint(features)))
            lengths.append(len(part))
            base += len(part)
        if len(known) > CACHED:
            known.clear()
    times = [1] * len(lengths) + [bare[n] for n in sorted(bare)]
    for n in sorted(bare):
        at.extend(range(base, base + n))
        of.extend([constant] * n)
        labels.extend([0] * n)
        lengths.append(n)
        base += n
    weights, t = crf.fit((np.array(at), np.array(of)), np.array(labels), np.array(lengths), constant + 1, steps=80, rate=0.3, times=np.array(times))
    model = ToxicSpans({n: float(weights[i]) for n, i in index.items() if abs(weights[i]) > 1e-6}, float(weights[constant]), t, None, rate)
    seen = np.array([model.summary(text) for text, _ in rows])
    model.calibration = crf.fit_logistic(seen, y.astype(float), np.ones(len(y)))
    model.cache = model.powers = None
    return model


def score_toxicity(df: DataFrame, model: ToxicSpans, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, score, spans (start and end of each toxic token in code points)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for rows, texts in blocks(batches):
            read = [model.read(text) for text in texts]
            spans = [[{"start": a, "end": b} for a, b in found] for _, found in read]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([score for score, _ in read], pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    plain = df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return plain.mapInArrow(score, "doc_id long, score double, spans array<struct<start: int, end: int>>")


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, most_toxic: int = 1500, most_clean: int = 3000, most_bytes: int = 32 << 20) -> ToxicSpans:
    return fit(training_texts(docs, labels, "toxic", {1: most_toxic, 0: most_clean}, most_bytes=most_bytes))


def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
