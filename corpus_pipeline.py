"""A corpus pipeline of five stages: quality, near duplicates, decontamination, mixture, token files.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but
the last return the columns of ``documents``.

Cases: a null text counts as an empty one, is near to nothing and has no benchmark window. Rows with a null doc_id,
source or any other null go through. Of equal texts, and of rows repeated with the same doc_id, one row stays. Texts of
any length are read whole. Further columns may have any name, also one that a stage uses itself, and keep their values.
An empty table gives no rows; without labels every document is kept by the first stage's neutral score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm.decontaminate import keep_uncontaminated
from lexispark.llm.jaccard_join import keep_one_of_each
from lexispark.llm.line_quality import fit_quality, keep_good
from lexispark.llm.mix_sources import repeat_to_mix
from lexispark.llm.shared import documents, materialize
from lexispark.llm.token_files import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line classifier, fitted on the labelled ones, scores under 0.3."""
    return keep_good(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group that 5-word shingle similarities of 0.8 or more link."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words lie in 13-word windows of ``benchmark``."""
    return keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source has its share of words."""
    return repeat_to_mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and returns what they hold for each document."""
    return encode_documents(spark, docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: The fitted classifier and the iterated mixture can't be said in SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
