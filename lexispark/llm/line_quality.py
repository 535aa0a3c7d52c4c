"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features (shares of capitals, digits, symbols,
exclamation and table marks, words that repeat the word before, word length, whether the line
occurs twice)
stand beside those of the lines before and after it. Training lines take their document's label; then
lines of bad documents that the model calls good change theirs, and the model is fitted again.
A document's score is a calibrated function of the forward-backward marginals'
mean, weighted by the lines' lengths.

Fitted on at most ``most_good`` and ``most_bad`` labelled documents in the order of a hash, up to the one that brings them to ``most_bytes``, none of them held out; training
chains are cut at ``CHAIN`` lines.

Cases: null and empty texts are one empty line. Any length is scored whole. Without labelled
documents of both classes every score is 0.5. Rows that repeat get equal scores.
An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .labelled import held_out, training_texts
from .shared import documents

#: Classes of bytes: 1 capital, 2 small letter or part of a longer character, 3 digit, 4 symbol, 5 exclamation, 6 bar, 7 sentence mark, 0 the rest.
CLASS_OF = np.zeros(256, np.uint8)
CLASS_OF[65:91], CLASS_OF[97:123], CLASS_OF[128:] = 1, 2, 2
CLASS_OF[48:58] = 3
CLASS_OF[list(b"#$%&*+<=>@\\^_`{}~[]/")] = 4
CLASS_OF[ord("!")], CLASS_OF[ord("|")] = 5, 6
CLASS_OF[list(b".,;:?")] = 7
N_OWN = 9
#: Bytes of text that are looked at together when scoring and when fitting, and lines of a training chain.
BLOCK, FITTED, CHAIN = 1 << 20, 1 << 18, 256


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines of all texts, their lengths in bytes, and the number of lines of each text."""
    lines = [t.split("\n") for t in texts]
    n_lines = np.array([len(x) for x in lines])
    raw = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.concatenate([np.flatnonzero(raw == 10), [len(raw)]])
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = np.maximum(1, ends - starts)
    kinds = CLASS_OF[raw]
    words, again, twin = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size))
    i = 0
    for of_text in lines:
        seen = Counter(of_text) if len(of_text) > 1 else {}
        for line in of_text:
            w = line.split()
            words[i], again[i] = len(w), sum(map(operator.eq, w, w[1:]))
            twin[i] = bool(w) and seen.get(line, 1) > 1
            i += 1
    count = []
    for kind in range(1, 8):
        total = np.concatenate([[0], np.cumsum(kinds == kind, dtype=np.int64)])
        count.append(total[ends] - total[starts])
    # Shares lean to 0 in short lines; those of rare marks count up to one in ten characters.
    letters = count[0] + count[1]
    marks = [np.minimum(1, 10 * c / (size + 10)) for c in count[2:]]
    out = np.stack([count[0] / (letters + 20), *marks, again / (words + 5), np.minimum(2, (letters + 25) / (words + 5) / 6), twin], axis=1)
    return out, size.astype(float), n_lines


def with_neighbours(own: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after in the same text (zeros outside it), and 1."""
    first = np.cumsum(n_lines) - n_lines
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[first + n_lines - 1] = 0, 0
    return np.column_stack([own, before, after, np.ones(len(own))])


@dataclass
class LineQuality:
    weights: np.ndarray
    t: np.ndarray
    calibration: np.ndarray | None

    def line_marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, size, n_lines = line_features(texts)
        return crf.marginals(with_neighbours(own, n_lines) @ self.weights, crf.Chains(n_lines), self.t), size, n_lines

    def means(self, texts: list[str]) -> np.ndarray:
        p, size, n_lines = self.line_marginals(texts)
        first = np.cumsum(n_lines) - n_lines
        return np.add.reduceat(p * size, first) / np.add.reduceat(size, first)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(texts), 0.5)
        return crf.sigmoid(_stretched(self.means(texts)) @ self.calibration[:-1] + self.calibration[-1])


def _stretched(means: np.ndarray) -> np.ndarray:
    q = np.clip(means, 1e-4, 1 - 1e-4)
    return np.column_stack([q, np.log(q / (1 - q)) / 4])


def fit(rows: list[tuple[str, int]], *, rounds: int = 3) -> LineQuality:
    y = np.array([label for _, label in rows])
    if len(set(y.tolist())) < 2:
        return LineQuality(np.zeros(3 * N_OWN + 1), np.zeros(3), None)
    at = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([text for text, _ in rows], pa.large_string())], ["row", "text"])
    own, size, n_lines = (np.concatenate(part) for part in zip(*(line_features(some) for _, some in blocks(iter([at]), FITTED)), strict=True))
    chains = np.concatenate([[*[CHAIN] * ((n - 1) // CHAIN), (n - 1) % CHAIN + 1] for n in n_lines.tolist()])
    x, of_text = with_neighbours(own, n_lines), np.repeat(y, n_lines)
    labels = of_text.copy()
    first = np.cumsum(n_lines) - n_lines
    for _ in range(rounds):
        weights, t = crf.fit(x, labels, chains, x.shape[1])
        p = crf.marginals(x @ weights, crf.Chains(n_lines), t)
        worst = np.repeat(np.minimum.reduceat(p, first), n_lines)
        labels = np.where((of_text == 0) & (p > 0.9) & (worst < 0.5), 1, of_text)
    model = LineQuality(weights, t, None)
    means = np.add.reduceat(p * size, first) / np.add.reduceat(size, first)
    share = y.mean()
    model.calibration = crf.fit_logistic(_stretched(means), y.astype(float), np.where(y == 1, 0.5 / share, 0.5 / (1 - share)))
    return model


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK, text_at: int = 1) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Consecutive rows with about ``most`` bytes of text together (one row at least), and their texts; only these become Python objects.

    At the end Arrow gives back what it holds unused, as the worker goes on to other tasks.
    """
    for batch in batches:
        texts = batch.column(text_at)
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, done + most)) + 1)
            stop = min(stop, len(ends))
            yield batch.slice(at, stop - at), texts.slice(at, stop - at).to_pylist()
            at, done = stop, int(ends[stop - 1])
    pa.default_memory_pool().release_unused()


def score_quality(df: DataFrame, model: LineQuality, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.scores(texts))], ["doc_id", "score"])

    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).mapInArrow(score, "doc_id long, score double")


def keep_good(df: DataFrame, model: LineQuality, *, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows of ``df`` with a score of ``threshold`` or more, all columns."""
    column = df.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, text_at=column):
            yield rows.filter(pa.array(model.scores([text or "" for text in texts]) >= threshold))

    return df.mapInArrow(keep, df.schema)


def fit_quality(docs: DataFrame, labels: DataFrame, *, most_good: int = 2000, most_bad: int = 2000, most_bytes: int = 32 << 20) -> LineQuality:
    return fit(training_texts(docs, labels, "quality", {1: most_good, 0: most_bad}, most_bytes=most_bytes))


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
