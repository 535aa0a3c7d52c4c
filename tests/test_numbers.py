import duckdb
from pyspark.sql import functions as F

from lexispark.functions.numbers import rounded
from lexispark.operators import prompt


def test_rounds_as_duckdb(spark):
    """All similarities of four places to three, where Spark's own round differs for some halves."""
    values = [i / 10_000 for i in range(10_001)]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(rounded(F.col("v"), 3).alias("x")).collect()]
    listed = ",".join(f"({i}, CAST({v!r} AS DOUBLE))" for i, v in enumerate(values))
    assert got == [r[0] for r in duckdb.sql(f"SELECT round(v, 3) FROM (VALUES {listed}) t(i, v) ORDER BY i").fetchall()]


def test_cited_similarity(spark):
    chunk = spark.createDataFrame([("d", "t", 1, 0.5025, 0.03)], "doc_id string, text string, page_number int, similarity double, score double")
    assert chunk.select(F.struct(*prompt.citation_columns()).alias("c")).first().c.score == 0.502
