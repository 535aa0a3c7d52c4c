"""Stored postings for BM25: questions are answered without reading texts, and blocks that can't hold a winner aren't read.

Documents that lie together make a range. A row of the postings is a block: one term's documents of one range, with their
term counts and lengths, and the largest BM25 part that any of them can get. So a range's documents score at most the sum of its
blocks' bounds, and each document's whole score is made in its range alone. A task makes the blocks of its own documents, so
building shuffles nothing but the number of documents of each term.

A search first reads the blocks' heads (term, range, bound), evaluates the few ranges with the highest bounds of each question, and takes the k-th
score that it found as a threshold; only ranges whose bound reaches it are evaluated then. The result is the same as that of a search through all texts.
A frequent term has many blocks of bounded size, so it isn't one task's.

Many or long questions meet nearly every document, and a row for each such pair would fill any disk. For them texts stream past blocks of
questions (``search_streamed``), and only k rows of each question leave a task; ``search_each`` takes the way that fits.

Scores are ranked by 9 places, then by id, so that the order in which parts are added doesn't decide between equal texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import SIDE_BY_SIDE, setting, written
from .dense import Best
from .lexical import B, K1, TEXTS, WORDS, weighted

#: Documents of a range, folders of postings, and ranges that are evaluated for the threshold.
RANGE_DOCS, BUCKETS, FIRST = 256, 32, 2
#: Terms of all questions that go to every task.
MOST_TERMS = 1024
#: Documents and words that are counted together, at most (one document at least).
PIECE_DOCS, PIECE_WORDS = 4096, 1 << 19


def _part(tf: Column, dl: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.try_divide(dl, average)))


def _parts(tf: np.ndarray, dl: np.ndarray, average: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def _pieces(batch: pa.RecordBatch, column: str, docs: int) -> Iterator[pa.RecordBatch]:
    ends, at = np.cumsum(pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)), 0
    while at < len(ends):
        most = int(ends[at - 1]) * (at > 0) + PIECE_WORDS
        stop = min(at + docs, max(at + 1, int(np.searchsorted(ends, most, "right"))), len(ends))
        yield batch.slice(at, stop - at)
        at = stop


def _placed(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different terms in order, and the place of each one given."""
    coded = flat.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def _counted(words: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms in order; of each term and row that has it, by term, then row: the term's place, the row, how often; and each row's number of words."""
    dl = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, row = words.flatten(), np.repeat(np.arange(len(words)), dl)
    if flat.null_count:
        row, flat = row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
    terms, place = _placed(flat)
    n = max(1, len(words))
    key, tf = np.unique(place * n + row, return_counts=True)
    return terms, key // n, key % n, tf, dl


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class Postings:
    path: str
    texts: int
    words: int
    buckets: int
    id_type: str

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Postings:
        return cls(path, **json.loads(spark.read.text(f"{path}/sizes").first()[0]))

    def blocks(self, spark: SparkSession) -> DataFrame:
        """term, range, docs, bound, postings (array of id, tf, dl), bucket."""
        return spark.read.schema(f"{block_schema(self.id_type)}, bucket int").parquet(f"{self.path}/blocks")

    def statistics(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("term string, df long, idf double, average double").parquet(f"{self.path}/statistics")


def block_schema(id_type: str) -> str:
    return f"term string, range long, docs int, bound float, postings array<struct<id: {id_type}, tf: int, dl: int>>"


def build_postings(words: DataFrame, path: str, *, range_docs: int = RANGE_DOCS, buckets: int = BUCKETS) -> Postings:
    """Writes postings and statistics of a corpus (id, words) at ``path``. Ids are unique; texts without words count, but have no postings.

    ``words`` is read twice, for its sizes and for its blocks; bounds need the average length. A corpus that is itself a join is better stored first.
    """
    spark = words.sparkSession
    id_type = words.schema["id"].dataType.simpleString()
    split = words.select("id", F.coalesce("words", F.array().cast("array<string>")).alias("words"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Not an aggregate over the words' column, in which Spark makes the words anew for each place that they are named in.
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([len(batch.column("words").flatten())], pa.int64())], ["n", "w"])

    sizes = split.mapInArrow(counted, "n long, w long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    average = sizes.w / max(1, sizes.n)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        nth = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in _pieces(batch, "words", min(range_docs, PIECE_DOCS)):
                terms, term, row, tf, dl = _counted(piece.column("words"))
                if len(terms):
                    starts = np.searchsorted(term, np.arange(len(terms) + 1))
                    # The next larger float, so that it is a bound still.
                    bound = np.nextafter(np.maximum.reduceat(_parts(tf, dl[row], average), starts[:-1]).astype(np.float32), np.float32(np.inf))
                    each = pa.StructArray.from_arrays([piece.column("id").take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(dl[row], pa.int32())], ["id", "tf", "dl"])
                    held = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), each)
                    yield pa.RecordBatch.from_arrays([terms, pa.array(np.full(len(terms), nth)), pa.array(np.diff(starts), pa.int32()), pa.array(bound), held], ["term", "range", "docs", "bound", "postings"])
                nth += 1

    blocks = split.mapInArrow(listed, block_schema(id_type)).withColumn("bucket", _bucket(F.col("term"), buckets))
    # A file for each folder is open in a task, as a sort by folder would spill more than the blocks take up.
    with setting(spark, SIDE_BY_SIDE, str(buckets)):
        blocks.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/blocks")
    said = {"texts": sizes.n, "words": sizes.w, "buckets": buckets, "id_type": id_type}
    spark.createDataFrame([(json.dumps(said),)], "text string").coalesce(1).write.mode("overwrite").text(f"{path}/sizes")
    built = Postings(path, **said)
    # A term's documents are those of its blocks, so the statistics need no pass over words.
    whole = spark.createDataFrame([(TEXTS, sizes.n), (WORDS, sizes.w)] if sizes.n else [], "term string, df long")
    per_term = built.blocks(spark).groupBy("term").agg(F.sum("docs").cast("long").alias("df"))
    written(weighted(per_term.unionByName(whole)), f"{path}/statistics")
    return built


def question_terms(index: Postings, questions: DataFrame) -> DataFrame:
    """query_id, term, times, weight (times * idf), average, bucket of each known term of questions (query_id, words)."""
    each = questions.select("query_id", F.explode("words").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    known = index.statistics(questions.sparkSession).select("term", "idf", "average")
    return each.join(known, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"), "average", _bucket(F.col("term"), index.buckets).alias("bucket"))


def bounds(index: Postings, terms: DataFrame) -> DataFrame:
    """query_id, range, bound, nth: what each range's documents can score at most, highest first."""
    heads = index.blocks(terms.sparkSession).select("bucket", "term", "range", "bound")
    most = heads.join(terms, ["bucket", "term"]).groupBy("query_id", "range").agg(F.sum(F.greatest(F.col("weight"), F.lit(0.0)) * F.col("bound")).alias("bound"))
    return most.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")))


def _evaluated(index: Postings, terms: DataFrame, ranges: DataFrame) -> DataFrame:
    """query_id, id, score (9 places) of the documents in these ranges (query_id, range)."""
    blocks = index.blocks(terms.sparkSession).select("bucket", "term", "range", "postings")
    found = blocks.join(terms, ["bucket", "term"]).join(ranges.select("query_id", "range"), ["query_id", "range"]).select("query_id", "weight", "average", F.explode("postings").alias("p"))
    part = F.col("weight") * _part(F.col("p.tf"), F.col("p.dl"), F.col("average"))
    return found.groupBy("query_id", F.col("p.id").alias("id")).agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")


def _best(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int")
    return scored.withColumn("bm25_rank", place).where(F.col("bm25_rank") <= k)


def reached(index: Postings, terms: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """The best documents of each question's first ranges, and the other ranges that may hold better ones (query_id, range)."""
    most = bounds(index, terms).where("bound > 0")
    found = _best(_evaluated(index, terms, most.where(F.col("nth") <= first)), k)
    edge = found.where(F.col("bm25_rank") == k).select("query_id", F.col("score").alias("edge"))
    rest = most.where(F.col("nth") > first).join(edge, "query_id", "left")
    return found, rest.where(F.col("bound") + 1e-6 >= F.coalesce("edge", F.lit(0.0))).select("query_id", "range")


def search(index: Postings, questions: DataFrame, k: int, *, first: int = FIRST) -> DataFrame:
    """query_id, id, score, bm25_rank: the k best documents of each question (query_id, words), with a score above 0."""
    terms = question_terms(index, questions)
    few = _few(terms, MOST_TERMS)
    return _searched(index, terms if few is None else few, k, first)


def _few(terms: DataFrame, most: int) -> DataFrame | None:
    """The terms as rows that go to every task, so that no blocks are shuffled to meet them; none if there are more than ``most``."""
    rows = terms.limit(most + 1).collect()
    return F.broadcast(terms.sparkSession.createDataFrame(rows, terms.schema)) if len(rows) <= most else None


def _searched(index: Postings, terms: DataFrame, k: int, first: int) -> DataFrame:
    found, rest = reached(index, terms, k, first)
    more = _evaluated(index, terms, rest)
    return _best(found.select("query_id", "id", "score").unionByName(more), k)


#: Words of the texts that one task reads, terms and questions of a block of questions, at most (about, as all are dealt by hashes).
SEGMENT_WORDS, BLOCK_TERMS, BLOCK_QUESTIONS = 1 << 21, 1 << 20, 2048
#: Terms that no more questions of a block have are scored together.
FEW = 4


class _Asked:
    """A block of questions, and the k best documents of each while texts stream by.

    Each score is added up in the order of terms, those of few questions first, whatever the document: equal texts have equal scores.
    """

    def __init__(self, names: list, terms: pa.ListArray, weights: pa.ListArray, average: float, k: int):
        self.average, self.best = average, Best(names, k)
        self.terms, term = _placed(terms.flatten())
        question = np.repeat(np.arange(len(names)), pc.list_value_length(terms).to_numpy())
        order = np.lexsort((question, term))
        self.question, self.weight = question[order], weights.flatten().to_numpy()[order]
        self.starts = np.searchsorted(term[order], np.arange(len(self.terms) + 1))

    def see(self, ids: list, words: pa.ListArray) -> None:
        n, questions = len(ids), len(self.best.names)
        terms, term, row, tf, dl = _counted(words)
        known = pc.index_in(terms, value_set=self.terms).fill_null(-1).to_numpy()[term]
        some = known >= 0
        known, row, tf = known[some], row[some], tf[some]
        part, first, times = _parts(tf, dl[row], self.average), self.starts[known], self.starts[known + 1] - self.starts[known]
        few = times <= FEW
        each = np.repeat(np.flatnonzero(few), times[few])
        at = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(times[few]) - times[few], times[few])
        scores = np.bincount(self.question[at] * n + row[each], self.weight[at] * part[each], questions * n).reshape(questions, n)
        known, row, part = known[~few], row[~few], part[~few]
        edges = np.flatnonzero(np.diff(known, prepend=-1, append=-1)).tolist() if len(known) else []
        for a, b in zip(edges, edges[1:]):
            s, e = self.starts[known[a]], self.starts[known[a] + 1]
            scores[np.ix_(self.question[s:e], row[a:b])] += np.outer(self.weight[s:e], part[a:b])
        self.best.keep(range(questions), -np.round(scores, 9), ids)


def search_streamed(index: Postings, words: DataFrame, questions: DataFrame, k: int, *, segment_words: int = SEGMENT_WORDS, block_terms: int = BLOCK_TERMS, block_questions: int = BLOCK_QUESTIONS) -> DataFrame:
    """As ``search``, for many or long questions: the index's texts (id, words) stream past the questions, its statistics weigh the terms.

    Texts are dealt over segments and questions over blocks; a task holds one block's terms and a piece of one segment. Texts are shuffled once a block and
    questions once a segment, and no row for a question and a text leaves a task but the k best ones.
    """
    terms = question_terms(index, questions)
    sizes = terms.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("query_id").alias("questions")).first()
    blocks = max(1, -(-sizes.terms // block_terms), -(-sizes.questions // block_questions))
    segments = max(1, -(-index.words // segment_words))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda column, salt, n: F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(n)).cast("int")
    id_type, query_type = index.id_type, questions.schema["query_id"].dataType.simpleString()
    asked = terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("t"), F.first("average").alias("average"))
    asked = asked.select(every(segments).alias("segment"), dealt("query_id", 2, blocks).alias("block"), F.lit(0).alias("part"), F.lit(None).cast(id_type).alias("id"), "query_id", F.col("t.term").alias("words"), F.col("t.weight").alias("weights"), "average")
    # Texts without words can't be found, and wait for no question.
    texts = words.where(F.size("words") > 0).select(dealt("id", 1, segments).alias("segment"), every(blocks).alias("block"), F.lit(1).alias("part"), "id", F.lit(None).cast(query_type).alias("query_id"), "words", F.lit(None).cast("array<double>").alias("weights"), F.lit(None).cast("double").alias("average"))
    rows = asked.unionByName(texts).repartition("segment", "block").sortWithinPartitions("segment", "block", "part", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None

        def tell() -> Iterator[pa.RecordBatch]:
            if block is not None and (found := [r for r in block.best.rows() if r[2] < 0]):
                names, ids, far = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(names), types[0]), pa.array(list(ids), types[1]), pa.array([-x for x in far])], ["query_id", "id", "score"])

        for batch in batches:
            types = [batch.schema.field("query_id").type, batch.schema.field("id").type]
            keys = np.stack([batch.column(c).to_numpy() for c in ("segment", "block", "part")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(edges, edges[1:]):
                *key, part = keys[a].tolist()
                if key != now:
                    yield from tell()
                    now, held, block = key, [], None
                if part == 0:
                    held.append(batch.slice(a, b - a))
                elif held:
                    if block is None:
                        column = lambda name: pa.concat_arrays([x.column(name) for x in held])  # noqa: B023, E731
                        block = _Asked(column("query_id").to_pylist(), column("words"), column("weights"), held[0].column("average")[0].as_py(), k)
                    for piece in _pieces(batch.slice(a, b - a), "words", PIECE_DOCS):
                        block.see(piece.column("id").to_pylist(), piece.column("words"))
        yield from tell()
        pa.default_memory_pool().release_unused()

    return _best(rows.mapInArrow(run, f"query_id {query_type}, id {id_type}, score double"), k)


def search_each(index: Postings, words: DataFrame, questions: DataFrame, k: int, *, most_terms: int = MOST_TERMS) -> DataFrame:
    """As ``search``: from stored postings for up to ``most_terms`` terms of all questions, else with the texts (id, words) streaming by."""
    few = _few(question_terms(index, questions), most_terms)
    if few is not None:
        return _searched(index, few, k, FIRST)
    return search_streamed(index, words, questions, k)
