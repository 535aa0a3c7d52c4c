"""An index of vectors by k-means cells: a query looks only at its nearest cells, and their vectors are ranked exactly.

The centroids are fitted on at most ``sample_rows`` rows (those whose ids hash lowest), in rounds of a distributed job that gives back one sum a cell.
Every row is indexed: it lies in the folder of its nearest cell, so a search reads the folders of the cells that are asked for.
Near equal cells are what k-means aims for, but one may hold most rows (copies, say): a search deals each cell's rows over tasks by their number.

Vectors with a null, of another dimension or without a length have no direction; they lie in a cell of their own, ``NOWHERE``, and every search
reads it, as they are at distance 1 of everything. Rows without an id are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dense

#: Cells at most: with 1,000 dimensions the centroids, which go to every task, are 32 MB.
MOST_CELLS, NOWHERE = 4096, -1


@dataclass
class VectorIndex:
    path: str
    centroids: np.ndarray  # a row of length 1 a cell
    schema: str  # of its rows

    def rows(self, spark: SparkSession) -> DataFrame:
        """id, embedding, cell; a filter on cell is a choice of folders."""
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        text = spark.read.text(f"{path}/centroids", wholetext=True).first()[0]
        said = json.loads(text)
        return cls(path, np.array(said["centroids"], float), said["schema"])


def _nearest_cells(embedding: pd.Series, centroids: np.ndarray, n: int) -> list[list[int]]:
    """The n nearest cells of each vector, nearest first; ``NOWHERE`` alone for those without a direction."""
    m = dense.unit_rows([None if v is None else list(v) for v in embedding], centroids.shape[1])
    near = np.argsort(-(m @ centroids.T), axis=1, kind="stable")[:, :n]
    return [row.tolist() if v.any() else [NOWHERE] for row, v in zip(near, m, strict=True)]


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, embedding, cell."""

    @F.pandas_udf("int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for embedding in batches:
            yield pd.Series([cells[0] for cells in _nearest_cells(embedding, centroids, 1)], dtype="int32")

    return vectors.select("id", "embedding", cell("embedding").alias("cell"))


def _moved(sample: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid goes to the mean direction of its vectors; one without any stays."""
    dimension = centroids.shape[1]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            m = dense.unit_rows([None if v is None else list(v) for v in frame["embedding"]], dimension)
            at = np.argmax(m @ centroids.T, axis=1)
            for c in np.unique(at).tolist():
                total[c] = total.get(c, np.zeros(dimension)) + m[at == c].sum(axis=0)
        if total:
            yield pd.DataFrame({"cell": list(total), "total": [t.tolist() for t in total.values()]})

    parts = sample.mapInPandas(sums, "cell int, total array<double>")
    summed = parts.groupBy("cell").agg(F.array(*(F.sum(F.col("total")[i]) for i in range(dimension))).alias("total"))
    moved = centroids.copy()
    for row in summed.collect():  # one row a cell
        length = np.linalg.norm(row.total)
        if length > 0:
            moved[row.cell] = np.array(row.total) / length
    return moved


def build_index(vectors: DataFrame, path: str, *, id_column: str = "vec_id", cells: int | None = None, sample_rows: int = 100_000, rounds: int = 6) -> VectorIndex:
    """Writes an index of all rows at ``path``. ``cells`` is about the square root of the number of rows if not given."""
    spark = vectors.sparkSession
    plain = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), "embedding")
    directed = plain.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    n = directed.count()
    common = directed.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = common.d if common else 1
    cells = max(1, min(MOST_CELLS, n, cells or round(n**0.5)))
    sample = directed.where(F.size("embedding") == dimension).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    folder = f"{path}/sample"
    sample.write.mode("overwrite").parquet(folder)
    sample = spark.read.parquet(folder)
    first = [r.embedding for r in sample.groupBy(F.xxhash64("embedding").alias("h")).agg(F.first("embedding").alias("embedding")).orderBy("h").limit(cells).collect()]
    centroids = dense.unit_rows(first, dimension) if first else np.ones((1, dimension)) / dimension**0.5
    for _ in range(rounds):
        centroids = _moved(sample, centroids)
    assigned(plain, centroids).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    schema = f"id {plain.schema['id'].dataType.simpleString()}, embedding {plain.schema['embedding'].dataType.simpleString()}, cell int"
    spark.createDataFrame([(json.dumps({"centroids": centroids.tolist(), "schema": schema}),)], "text string").coalesce(1).write.mode("overwrite").text(f"{path}/centroids")
    return VectorIndex(path, centroids, schema)


def search_index(index: VectorIndex, queries: DataFrame, k: int, *, id_column: str = "vec_id", probes: int = 8, segment_rows: int = dense.SEGMENT_ROWS, block_rows: int = dense.BLOCK_ROWS) -> DataFrame:
    """query_id, id, distance, dense_rank: the k nearest among the rows of each query's ``probes`` nearest cells, ranked exactly.

    ``probes`` of the number of cells or more is the exact search. A query without a direction is at distance 1 of everything and asks all cells.
    """
    spark, centroids = queries.sparkSession, index.centroids
    everywhere = list(range(len(centroids)))

    @F.pandas_udf("array<int>")
    def asked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for embedding in batches:
            yield pd.Series([[*(everywhere if cells == [NOWHERE] else cells), NOWHERE] for cells in _nearest_cells(embedding, centroids, probes)])

    plain = queries.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("query_id"), "embedding")
    probed = plain.select("query_id", "embedding", F.explode(asked("embedding")).alias("cell"))
    return dense.nearest_in_cells(index.rows(spark), probed, k, segment_rows=segment_rows, block_rows=block_rows)


def probes_for(index: VectorIndex, vectors: DataFrame, k: int, target: float, *, id_column: str = "vec_id", sample_queries: int = 200) -> int:
    """The least number of probes with which at least ``target`` of the exact neighbours of a sample of queries are in probed cells.

    The sample are the ``sample_queries`` rows whose ids hash lowest with a seed of its own; their neighbours' cells (``sample_queries`` * k rows) come to the driver.
    """
    asked = vectors.where(F.col(id_column).isNotNull()).orderBy(F.xxhash64(id_column, F.lit("probes")), id_column).limit(sample_queries)
    asked = vectors.sparkSession.createDataFrame(asked.select(id_column, "embedding").collect(), asked.select(id_column, "embedding").schema)
    near = dense.nearest_each(vectors, asked, k, id_column=id_column).where("distance < 1").select("query_id", "id")
    cells = index.rows(vectors.sparkSession).select("id", "cell").join(F.broadcast(near), "id").select("query_id", "cell").collect()
    queries = {r[id_column]: r.embedding for r in asked.collect()}
    order = dict(zip(queries, _nearest_cells(pd.Series(list(queries.values())), index.centroids, len(index.centroids)), strict=True))
    needed = sorted(order[r.query_id].index(r.cell) + 1 for r in cells if r.cell in order[r.query_id])
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] if needed else 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the share of the exact search's rows that were found. Ties at the last place count by distance."""
    edge = exact.groupBy("query_id").agg(F.max("distance").alias("edge"), F.count(F.lit(1)).alias("wanted"))
    near = found.join(edge, "query_id").where(F.col("distance") <= F.col("edge")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    per = edge.join(near, "query_id", "left").select(F.least(F.coalesce("n", F.lit(0)), F.col("wanted")).alias("n"), "wanted")
    return per.agg(F.count(F.lit(1)).alias("queries"), F.try_divide(F.sum("n"), F.sum("wanted")).alias("recall"))
