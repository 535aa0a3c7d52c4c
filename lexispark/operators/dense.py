"""Vector search by cosine similarity: one query as a broadcast row, many in blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded


def id_filter(column: str, ids: object) -> Column | None:
    """No predicate for None, empty lists, "" and 0; blanks in a list don't count; ids are compared as texts."""
    if not ids:
        return None
    if isinstance(ids, Iterable) and not isinstance(ids, (str, bytes)):
        listed = [str(i) for i in ids if str(i).strip()]
        return F.col(column).cast("string").isin(listed) if listed else None
    return F.col(column).cast("string") == str(ids)


def effective_filter(ids: object = None, one: object = None) -> object:
    return ids if ids is not None else one


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def similarity(distance: Column) -> Column:
    return F.when(distance.isNotNull(), rounded(F.greatest(F.lit(0.0), 1 - distance), 4))


def candidate_depth(top_k: int, total: int) -> int:
    return min(max(3 * top_k, 10), total)


def nearest(vectors: DataFrame, query: DataFrame, k: int, *, id_column: str = "vec_id", only: Column | None = None) -> DataFrame:
    """id, distance, dense_rank of the k nearest. ``query`` is one row with a column ``embedding``; one row is what is broadcast, a second one is an error."""
    rows = vectors if only is None else vectors.where(only)
    alone = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one query: use nearest_each"))).otherwise(F.first("embedding"))
    one = F.broadcast(query.limit(2).agg(alone.alias("q"), F.count(F.lit(1)).alias("asked")).where("asked > 0").select("q"))
    far = rows.crossJoin(one).select(F.col(id_column).alias("id"), (1 - cosine(F.col("embedding"), F.col("q"))).alias("distance"))
    top = far.orderBy("distance", "id").limit(k)
    return top.withColumn("dense_rank", F.row_number().over(Window.orderBy("distance", "id")).cast("int"))


def unit_rows(vectors: list, dimension: int) -> np.ndarray:
    """Rows of length 1; those of another dimension, with a null or without a length are 0."""
    m = np.array([v if v is not None and len(v) == dimension else np.zeros(dimension) for v in vectors], float).reshape(len(vectors), dimension)
    m = np.where(np.isnan(m).any(axis=1, keepdims=True), 0.0, m)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 0, length, 1)


class Best:
    """The k nearest rows of each query of a block, kept while rows stream by."""

    def __init__(self, names: list, k: int):
        self.names, self.k = names, k
        self.found: list[list[tuple]] = [[] for _ in names]

    def keep(self, places: Iterable[int], far: np.ndarray, ids: list) -> None:
        """``far``: a row for each of these queries, a column for each id; ids ascend, so that of equally near ones the first are kept."""
        edges = np.partition(far, self.k - 1, axis=1)[:, self.k - 1] if len(ids) > self.k else np.full(len(far), np.inf)
        for i, row, edge in zip(places, far, edges, strict=True):
            old = self.found[i]
            if len(old) == self.k and old[-1][0] < row.min():
                continue
            inside = np.flatnonzero(row < edge)
            some = np.concatenate([inside, np.flatnonzero(row == edge)[: self.k - len(inside)]]) if edge < np.inf else np.arange(len(ids))
            self.found[i] = sorted(old + [(float(row[j]), ids[j]) for j in some])[: self.k]

    def rows(self) -> list[tuple]:
        return [(name, i, far) for name, top in zip(self.names, self.found, strict=True) for far, i in top]


class Nearest(Best):
    """By vectors, for queries and rows."""

    def __init__(self, names: list, vectors: list, k: int):
        super().__init__(names, k)
        at: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            at.setdefault(len(v or ()), []).append(i)
        self.asked = {d: (places, unit_rows([vectors[i] for i in places], d)) for d, places in at.items()}

    def see(self, ids: list, vectors: list) -> None:
        order = sorted(range(len(ids)), key=ids.__getitem__)
        ids, vectors = [ids[i] for i in order], [vectors[i] for i in order]
        for d, (places, q) in self.asked.items():
            self.keep(places, np.round(1 - q @ unit_rows(vectors, d).T, 9), ids)


#: Vectors that one task reads for a block of queries, and queries of a block, at most (about, as both are dealt by hashes).
SEGMENT_ROWS, BLOCK_ROWS = 200_000, 512


def nearest_in_cells(vectors: DataFrame, queries: DataFrame, k: int, *, segment_rows: int = SEGMENT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, id, distance, dense_rank: the k nearest of those vectors (id, embedding, cell) that are in the cells of a query (query_id, embedding, cell).

    A cell's vectors are dealt over segments and its queries over blocks. One task streams a segment past a block, so it holds a block and
    one batch of vectors whatever a cell's size is, and only k rows a query leave it. A cell's numbers of rows, one row a cell, are all that is joined.
    """
    spread = lambda rows, name, most: rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    sizes = spread(vectors, "segments", segment_rows).join(spread(queries, "blocks", block_rows), "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    no_id, no_query = (F.lit(None).cast(rows.schema[c].dataType) for rows, c in ((vectors, "id"), (queries, "query_id")))
    held = vectors.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id", F.lit(1)), "segments").cast("int").alias("segment"), every("blocks").alias("block"), no_query.alias("query_id"), "id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.join(sizes, "cell").select("cell", every("segments").alias("segment"), F.pmod(F.xxhash64("query_id", F.lit(2)), "blocks").cast("int").alias("block"), "query_id", no_id.alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = asked.withColumn("part", F.lit(0))
    dealt = asked.unionByName(held.withColumn("part", F.lit(1))).repartition("cell", "segment", "block").sortWithinPartitions("cell", "segment", "block", "part")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, distance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, names, asked = None, None, [], []

        def tell() -> Iterator[pa.RecordBatch]:
            if best is not None and (rows := best.rows()):
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["query_id", "id", "distance"])

        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            types = [column("query_id").type, column("id").type, pa.float64()]
            keys = list(zip(column("cell").to_pylist(), column("segment").to_pylist(), column("block").to_pylist(), strict=True))
            parts, at = column("part").to_pylist(), 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at] and parts[end] == parts[at]:
                    end += 1
                if keys[at] != now:
                    yield from tell()
                    now, best, names, asked = keys[at], None, [], []
                if parts[at] == 0:
                    names += column("query_id").slice(at, end - at).to_pylist()
                    asked += column("embedding").slice(at, end - at).to_pylist()
                else:
                    best = best or Nearest(names, asked, k)
                    best.see(column("id").slice(at, end - at).to_pylist(), column("embedding").slice(at, end - at).to_pylist())
                at = end
        yield from tell()

    few = dealt.mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).cast("int")
    return few.withColumn("dense_rank", rank).where(F.col("dense_rank") <= k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, *, id_column: str = "vec_id", segment_rows: int = SEGMENT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, id, distance (9 places), dense_rank: the k nearest rows of each row of ``queries``, by distance, then id, exactly.

    Vectors with a null, of another dimension or without a length are at distance 1. Rows without an id are left out; ids of queries are unique.
    """
    plain = lambda rows, name: rows.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias(name), "embedding", F.lit(0).alias("cell"))
    return nearest_in_cells(plain(vectors, "id"), plain(queries, "query_id"), k, segment_rows=segment_rows, block_rows=block_rows)
