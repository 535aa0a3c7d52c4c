"""A question against a collection of chunks: dense and lexical candidates, their fusion, the relevance gate, and the answer's records.

Chunks have chunk_id, doc_id, text, page_number and embedding. The collection is scanned where it lies; what
comes back are ``top_k`` rows.
"""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator, Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..folders import new_folder, written
from ..functions.text import strip, tokens, with_prefix, without_stopwords
from . import dense, fusion, inverted, lexical, prompt, vector_index

Embed = Callable[[list[str]], list[list[float]]]
TOP = "chunk_id, doc_id, text, page_number, similarity, dense_rank, bm25_rank, score"


def normalised(vectors: list[list[float]]) -> list[list[float]]:
    """Vectors of length 1; those without a length stay."""
    v = np.asarray(vectors, float).reshape(len(vectors), -1)
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(length > 0, length, 1)).tolist()


def embed_chunks(chunks: DataFrame, embed: Embed, *, model_key: str = "e5-small", text_column: str = "text") -> DataFrame:
    """Adds ``embedding``: the model's vectors of the passages, of length 1. ``embed`` takes a batch of texts."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(normalised(embed(texts.tolist())))

    return chunks.withColumn("embedding", vectors(with_prefix(F.coalesce(F.col(text_column), F.lit("")), "passage", model_key)))


def embed_question(question: str, embed: Embed, *, model_key: str = "e5-small") -> list[float]:
    """The question's vector, of length 1."""
    text = asked(question)
    prefixed = text if "e5" not in model_key or text.startswith("query: ") else f"query: {text}"
    return normalised(embed([prefixed]))[0]


def asked(question: str | None) -> str:
    """The stripped question; a blank one is an error."""
    if not question or not question.strip():
        raise ValueError("the question is blank")
    return question.strip()


def question_tokens(spark: SparkSession, question: str) -> list[str]:
    return spark.range(1).select(without_stopwords(tokens(F.lit(question))).alias("w")).first().w


@dataclass
class Retrieval:
    question: str
    top: DataFrame  # TOP, best first, at most top_k rows
    gate: DataFrame  # one row: max_similarity, any_lexical, has_relevant_context
    total: int
    depth: int


def retrieve(chunks: DataFrame, question: str, vector: DataFrame, *, top_k: int = 4, doc_ids: object = None, least: float = 0.8) -> Retrieval:
    """``vector`` is one row with the question's ``embedding``. An empty collection gives no rows and a closed gate.

    The depth of both candidate lists follows the whole collection's size; BM25's statistics are those of the
    documents that the filter leaves.
    """
    spark, question, total = chunks.sparkSession, asked(question), chunks.count()
    depth = dense.candidate_depth(top_k, total)
    only = dense.id_filter("doc_id", doc_ids)
    some = chunks if only is None else chunks.where(only)
    near = dense.nearest(some, vector, depth, id_column="chunk_id")
    found = lexical.ranked(lexical.scores(lexical.tokenised(some, "chunk_id"), question_tokens(spark, question)), depth)
    best = fusion.fuse(near, found, top_k)
    # At most top_k rows are broadcast.
    top = some.select("chunk_id", "doc_id", "text", "page_number").join(F.broadcast(best), F.col("chunk_id") == F.col("id")).select(*TOP.split(", "))
    return Retrieval(question, top, fusion.gate(best, least), total, depth)


@dataclass
class Collection:
    """A stored collection with its indexes: chunks (chunk_id, doc_id, text, page_number), postings, and vectors that are either indexed or rows of (id, embedding)."""

    chunks: DataFrame
    postings: inverted.Postings
    vectors: vector_index.VectorIndex | DataFrame
    total: int

    @classmethod
    def build(cls, chunks: DataFrame, path: str, *, indexed: bool = False) -> Collection:
        """Writes a collection's chunks and postings, and with ``indexed`` a vector index, at ``path``.

        What ``chunks`` is made of is so read once, not by everything that needs texts or vectors.
        """
        chunks = written(chunks, f"{path}/chunks")
        postings = inverted.build_postings(lexical.tokenised(chunks, "chunk_id"), f"{path}/postings")
        vectors = chunks.select(F.col("chunk_id").alias("id"), "embedding")
        held = vector_index.build_index(vectors, f"{path}/vectors", id_column="id") if indexed else vectors
        return cls(chunks.drop("embedding"), postings, held, postings.texts)


@dataclass
class Retrievals:
    questions: DataFrame  # query_id, question
    top: DataFrame  # query_id, place, TOP: at most top_k rows a question
    gate: DataFrame  # a row a question: max_similarity, any_lexical, has_relevant_context
    depth: int


def retrieve_each(held: Collection, questions: DataFrame, *, top_k: int = 4, least: float = 0.8, probes: int = 8) -> Retrievals:
    """A whole retrieval for each question (query_id, question, embedding), all at once.

    Terms of few questions meet the stored postings, those of many stand in blocks that the chunks' words stream past, as vectors do; what is fused
    are two short lists a question. The ``top_k`` ids of each are written to the shared folder, as answers and the gate both read them. Blank questions are left out; they have no row in the gate either.
    """
    asked = questions.where(F.length(strip(F.col("question"))) > 0)
    depth = dense.candidate_depth(top_k, held.total)
    words = asked.select("query_id", without_stopwords(tokens(F.col("question"))).alias("words"))
    found = inverted.search_each(held.postings, lexical.tokenised(held.chunks, "chunk_id"), words, depth)
    vectors = asked.select("query_id", F.col("query_id").alias("id"), "embedding")
    if isinstance(held.vectors, vector_index.VectorIndex):
        near = vector_index.search_index(held.vectors, vectors, depth, id_column="id", probes=probes)
    else:
        near = dense.nearest_each(held.vectors, vectors, depth, id_column="id")
    best = written(fusion.fuse_each(near, found, top_k), new_folder(questions.sparkSession, "retrieved"))
    top = held.chunks.select("chunk_id", "doc_id", "text", "page_number").join(best, F.col("chunk_id") == F.col("id")).select("query_id", "place", *TOP.split(", "))
    return Retrievals(asked.select("query_id", strip(F.col("question")).alias("question")), top, fusion.gate_each(best, asked, least), depth)


def has_sufficient_context(found: Retrieval | DataFrame) -> bool:
    """The gate of a retrieval; of plain chunks, whether there are any."""
    if isinstance(found, Retrieval):
        return bool(found.gate.first().has_relevant_context)
    return found.limit(1).count() > 0


def best_first(*more: Column) -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), *more]


def answer_stream(found: Retrieval) -> DataFrame:
    """position, type, content, citations: the answer's tokens in order, then one record of sources.

    Without relevant context the tokens are those of the fixed sentence, and the sources are empty; the model is not asked.
    """
    place = F.row_number().over(Window.orderBy(*best_first(), "chunk_id"))
    rows = found.top.withColumn("place", place).select("place", "text", "page_number", F.struct(*prompt.citation_columns()).alias("citation"))
    listed = F.array_sort(F.collect_list(F.struct("place", "text", "page_number", "citation")))
    one = rows.agg(listed.alias("rows")).crossJoin(F.broadcast(found.gate.select("has_relevant_context")))
    first = F.get("rows", F.lit(0))
    answer = F.when(F.col("has_relevant_context"), prompt.mock_answer(first["text"], first["page_number"])).otherwise(F.lit(prompt.FALLBACK))
    cited = F.transform("rows", lambda r: r["citation"])
    cited = F.when(F.col("has_relevant_context"), cited).otherwise(F.slice(cited, 1, 0))
    told = F.transform(F.split(answer, " "), lambda piece: F.struct(F.lit("token").alias("type"), F.concat(piece, F.lit(" ")).alias("content"), F.slice(cited, 1, 0).alias("citations")))
    sources = F.array(F.struct(F.lit("sources").alias("type"), F.lit("").alias("content"), cited.alias("citations")))
    return one.select(F.posexplode(F.concat(told, sources)).alias("position", "record")).select("position", "record.*")


RECORDS = "position int, type string, content string, citations array<struct<doc_id: string, filename: string, page_number: int, score: double, snippet: string>>"
#: A language model: prompts to one run of tokens each.
Answer = Callable[[list[str]], Iterable[Iterable[str]]]


def _told(prompts: list[str], model: Answer) -> list[list[str]]:
    """The tokens of each prompt. A prompt that fails ends with a token that says so; the others keep their answers."""

    def drained(tokens: Iterable[str]) -> list[str]:
        out: list[str] = []
        try:
            for token in tokens:
                if token:
                    out.append(token)
        except Exception as error:
            out.append(prompt.ERROR.format(error=error))
        return out

    try:
        answers = list(model(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
    except Exception as error:
        if len(prompts) == 1:
            return [[prompt.ERROR.format(error=error)]]
        return [tokens for one in prompts for tokens in _told([one], model)]
    return [drained(tokens) for tokens in answers]


def answer_each(found: Retrievals, load: Callable[[], Answer] | None = None, *, batch: int = 16) -> DataFrame:
    """query_id, position, type, content, citations: each question's tokens in order, then one record of its sources.

    ``load`` makes the model, once a task; it gets ``batch`` prompts at a time, of questions with relevant context only. Others get the fixed sentence and
    no sources. Without ``load`` the answer repeats the best chunk.
    """
    chunk = F.struct("place", "text", "doc_id", "page_number", F.struct(*prompt.citation_columns()).alias("citation"))
    rows = found.top.groupBy("query_id").agg(F.array_sort(F.collect_list(chunk)).alias("rows"))
    one = found.questions.join(found.gate.select("query_id", "has_relevant_context"), "query_id").join(rows, "query_id", "left")
    first, opened = F.get("rows", F.lit(0)), F.col("has_relevant_context")
    cited = F.when(opened, F.transform("rows", lambda r: r["citation"])).otherwise(F.array().cast(RECORDS.partition("citations ")[2]))
    if load is None:
        said = F.when(opened, prompt.mock_answer(first["text"], first["page_number"])).otherwise(F.lit(prompt.FALLBACK))
        told = F.transform(F.split(said, " "), lambda piece: F.concat(piece, F.lit(" ")))
        answered = one.select("query_id", told.alias("told"), cited.alias("cited"))
    else:
        nothing = F.array().cast("array<struct<role: string, content: string>>")
        asked = prompt.chatml(prompt.messages(nothing, prompt.user_message(F.col("question"), prompt.context_block(F.col("rows")))))
        plain = one.select("query_id", F.when(opened, asked).alias("prompt"), cited.alias("cited"))
        kept = [f for f in plain.schema if f.name != "prompt"]
        schema = StructType([*kept, StructField("told", ArrayType(StringType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, without = load(), [f"{word} " for word in prompt.FALLBACK.split(" ")]
            for rows in batches:
                prompts = rows.column(1).to_pylist()
                told: list[list[str]] = [without] * len(prompts)
                at = [i for i, p in enumerate(prompts) if p is not None]
                for first in range(0, len(at), batch):
                    some = at[first : first + batch]
                    for i, tokens in zip(some, _told([prompts[i] for i in some], model), strict=True):
                        told[i] = tokens
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(told, pa.list_(pa.string()))], ["query_id", "cited", "told"])

        answered = plain.mapInArrow(run, schema)
    records = F.transform("told", lambda token: F.struct(F.lit("token").alias("type"), token.alias("content"), F.slice("cited", 1, 0).alias("citations")))
    sources = F.array(F.struct(F.lit("sources").alias("type"), F.lit("").alias("content"), F.col("cited").alias("citations")))
    return answered.select("query_id", F.posexplode(F.concat(records, sources)).alias("position", "record")).select("query_id", "position", "record.*")


async def answer_records(found: Retrieval, *, pause: float = 0.01) -> AsyncIterator[dict]:
    """The records of ``answer_stream`` in order, one at a time, for a caller that awaits them."""
    for row in await asyncio.to_thread(answer_stream(found).orderBy("position").collect):
        yield {"type": row.type, "content": row.content, "citations": [c.asDict() for c in row.citations]}
        await asyncio.sleep(pause)
