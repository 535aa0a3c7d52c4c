import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark import folders
from lexispark.operators import dense, vector_index


def table(spark, n=1500, d=8):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, d))
    rows = [(i, (centres[i % 30] + 0.4 * rng.normal(size=d)).tolist()) for i in range(n)]
    rows += [(5000 + i, rows[3][1]) for i in range(600)] + [(9000, [0.0] * d), (9001, None), (9002, [1.0]), (9003, [None] * d), (None, rows[0][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


@pytest.fixture(scope="module")
def built(spark):
    df = table(spark)
    return df, vector_index.build_index(df, folders.new_folder(spark, "index"), sample_rows=700)


def test_every_row_is_in_one_cell(spark, built):
    df, index = built
    rows = index.rows(spark)
    assert rows.count() == rows.select("id").distinct().count() == df.where("vec_id is not null").count()
    assert {r.id for r in rows.where(F.col("cell") == vector_index.NOWHERE).collect()} == {9000, 9001, 9002, 9003}
    assert 20 <= rows.select("cell").distinct().count() - 1 <= len(index.centroids) == 46
    again = vector_index.VectorIndex.open(spark, index.path)
    assert np.allclose(again.centroids, index.centroids)


def test_recall_and_exact_ranks(spark, built):
    df, index = built
    queries = df.where("vec_id % 10 = 0 and vec_id < 5000")
    exact = dense.nearest_each(df, queries, 10).cache()
    found = vector_index.search_index(index, queries, 10, probes=6).cache()
    measured = vector_index.recall(found, exact).first()
    assert measured.queries == 150 and measured.recall >= 0.9
    both = found.join(exact.withColumnRenamed("distance", "far"), ["query_id", "id"])
    assert both.where("distance <> far").count() == 0
    some = vector_index.recall(exact.where("dense_rank <= 5"), exact).first()
    assert some.recall == 0.5


def test_probes_reach_their_target(spark, built):
    df, index = built
    few, many = (vector_index.probes_for(index, df, 10, target, sample_queries=50) for target in (0.5, 0.95))
    assert 1 <= few <= many < len(index.centroids)
    queries = df.where("vec_id % 7 = 0 and vec_id < 5000")
    found = vector_index.search_index(index, queries, 10, probes=many)
    assert vector_index.recall(found, dense.nearest_each(df, queries, 10)).first().recall >= 0.9


def test_all_cells_are_the_exact_search(spark, built):
    """Also for queries without a direction, in small segments and blocks, and with a cell that holds hundreds of copies."""
    df, index = built
    queries = df.where("vec_id in (3, 30, 5000, 9000, 9001, 9002)")
    exact = dense.nearest_each(df, queries, 7)
    found = vector_index.search_index(index, queries, 7, probes=10**6, segment_rows=100, block_rows=2)
    key = lambda rows: sorted((r.query_id, r.dense_rank, r.id, r.distance) for r in rows.collect() if r.query_id != 9002)
    assert key(found) == key(exact)


def test_a_search_reads_the_cells_it_asks(spark, built):
    _, index = built
    plan = index.rows(spark).where("cell in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert 0 < len({f.rpartition("/")[0] for f in (r[0] for r in index.rows(spark).where("cell = 1").select(F.input_file_name()).collect())}) == 1


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index = vector_index.build_index(none, folders.new_folder(spark, "index"))
    assert len(index.centroids) == 1
    assert vector_index.search_index(index, spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), 3).count() == 0
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    index = vector_index.build_index(some, folders.new_folder(spark, "index"))
    assert vector_index.search_index(index, none, 3).count() == 0
    assert [r.id for r in vector_index.search_index(index, some.where("vec_id = 2"), 1).collect()] == [2]


def test_one_query_only(spark, built):
    df, _ = built
    with pytest.raises(Exception, match="nearest_each"):
        dense.nearest(df, df.limit(2), 3).collect()
    assert dense.nearest(df, df.limit(0), 3).count() == 0
