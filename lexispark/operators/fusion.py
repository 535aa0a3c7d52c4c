"""Reciprocal rank fusion and the relevance gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dense import similarity


def fuse(dense: DataFrame, lexical: DataFrame, top_k: int, *, rrf_k: int = 60) -> DataFrame:
    """id, similarity, dense_rank, bm25_rank, score: by rounded score, then dense rank, then lexical rank."""
    return _fused(dense, lexical, ["id"], rrf_k).orderBy(*_best_first()).limit(top_k)


def _best_first() -> list:
    return [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank")]


def _fused(dense: DataFrame, lexical: DataFrame, keys: list[str], rrf_k: int) -> DataFrame:
    both = dense.join(lexical.select(*keys, "bm25_rank"), keys, "full_outer")
    part = lambda rank: F.coalesce(1 / (rrf_k + F.col(rank)), F.lit(0.0))
    return both.select(*keys, similarity(F.col("distance")).alias("similarity"), "dense_rank", "bm25_rank", F.round(part("dense_rank") + part("bm25_rank"), 6).alias("score"))


def fuse_each(dense: DataFrame, lexical: DataFrame, top_k: int, *, rrf_k: int = 60) -> DataFrame:
    """The fusion of each question: query_id, id, similarity, dense_rank, bm25_rank, score, place. Both inputs hold some rows a question."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*_best_first())).cast("int")
    return _fused(dense, lexical, ["query_id", "id"], rrf_k).withColumn("place", place).where(F.col("place") <= top_k)


def _facts() -> list:
    return [F.coalesce(F.max("similarity"), F.lit(0.0)).alias("max_similarity"), F.coalesce(F.bool_or(F.col("bm25_rank").isNotNull()), F.lit(False)).alias("any_lexical")]


def gate(top: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: max_similarity, any_lexical, has_relevant_context."""
    return top.agg(*_facts()).withColumn("has_relevant_context", (F.col("max_similarity") >= least) | F.col("any_lexical"))


def gate_each(top: DataFrame, questions: DataFrame, least: float = 0.8) -> DataFrame:
    """One row a question (query_id), also for those without any candidate."""
    known = questions.select("query_id").join(top.groupBy("query_id").agg(*_facts()), "query_id", "left")
    filled = known.select("query_id", F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"), F.coalesce("any_lexical", F.lit(False)).alias("any_lexical"))
    return filled.withColumn("has_relevant_context", (F.col("max_similarity") >= least) | F.col("any_lexical"))
