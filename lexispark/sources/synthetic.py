"""Synthetic questions over any chunks, for trying out an evaluation before one is written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Kinds of questions and placeholder texts.
KINDS = ["مستقیم", "تفسیری", "مقایسه‌ای"]
QUESTION = "[نمونه‌ی جای‌گذاری‌شده] سوال %s شماره %d درباره‌ی %s"
ANSWER = "[نمونه‌ی جای‌گذاری‌شده] پاسخ مرجع باید در F-06 توسط انسان نوشته شود."


def build_questions(chunks: DataFrame, *, per_document: int = 3, support: int = 2, seed: int = 42) -> DataFrame:
    """``per_document`` questions for each doc_id of ``chunks`` (schemas.QUESTION), each with at most ``support`` chunk ids.

    The supporting chunks are those whose digests with the seed and the question's number come first, so reruns agree.
    """
    asked = chunks.select(F.col("doc_id").cast("string").alias("doc_id"), "chunk_id", F.explode(F.sequence(F.lit(1), F.lit(per_document))).alias("i"))
    asked = asked.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("i").cast("string"), F.col("chunk_id"))))
    drawn = F.row_number().over(Window.partitionBy("doc_id", "i").orderBy("draw", "chunk_id"))
    few = asked.withColumn("drawn", drawn).where(F.col("drawn") <= support)
    listed = few.groupBy("doc_id", "i").agg(F.array_sort(F.collect_list(F.struct("drawn", "chunk_id"))).alias("few"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("i") - 1) % len(KINDS) + 1)
    return listed.select(
        F.format_string("%s_qa%03d", "doc_id", "i").alias("qa_id"), "doc_id", F.format_string(QUESTION, kind, F.col("i"), F.col("doc_id")).alias("question"), kind.alias("question_type"),
        F.lit(ANSWER).alias("answer_reference"), F.transform("few", lambda c: c["chunk_id"]).alias("supporting_chunk_ids"),
    )
