"""A stored corpus whose term statistics follow its changes.

Beside the chunks stands a table of what each document of a collection adds to the counts: how many of its chunks hold a term, how many chunks it has and how many
words. A change of some chunks reads these chunks, as they were, and the counts of the terms that they had or get; both tables change in one
commit. So the statistics of any choice of documents are a sum over the counts, and equal a fresh count of that choice's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexical, store

CHUNKS = "collection string, chunk_id string, doc_id string, text string, seq long"
COUNTS = "collection string, doc_id string, term string, df long"


class Corpus:
    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 16, **more):
        self.store = store.Store(spark, path, {"chunks": store.Spec(CHUNKS, ("collection", "chunk_id"), "seq", buckets), "counts": store.Spec(COUNTS, ("collection", "doc_id", "term"), None, buckets)}, **more)

    def chunks(self) -> DataFrame:
        return self.store.read("chunks")

    def counts(self) -> DataFrame:
        return self.store.read("counts").where("df <> 0")

    def _counted(self, rows: DataFrame, sign: int) -> DataFrame:
        words = lexical.without_stopwords(lexical.tokens(F.col("text")))
        each = rows.select("collection", "doc_id", F.explode(lexical.entries(words)).alias("e"))
        return each.select("collection", "doc_id", "e.term", (sign * F.col("e.n")).alias("df"))

    def _recount(self, change: store.Transaction, before: DataFrame, after: DataFrame) -> None:
        """Adds what ``after`` has more than ``before`` to the counts; only counts that change are written."""
        keys = ["collection", "doc_id", "term"]
        more = self._counted(before, -1).unionByName(self._counted(after, 1)).groupBy(*keys).agg(F.sum("df").alias("more")).where("more <> 0")
        old = change.read("counts")
        same = [F.col(f"m.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
        joined = more.alias("m").join(old.alias("o"), same, "left")
        change.upsert("counts", joined.select(*(F.col(f"m.{k}").alias(k) for k in keys), (F.coalesce("o.df", F.lit(0)) + F.col("more")).alias("df")))

    def upsert(self, rows: DataFrame) -> None:
        """Of rows with equal keys the one with the highest ``seq`` stays, of equal ones a new one."""
        keys = ["collection", "chunk_id"]
        rows = rows.select(*(f.name for f in store._struct(CHUNKS).fields))
        newest = store.upsert(rows.limit(0), rows, keys)
        with self.store.transaction() as change:
            named = [F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
            before = change.read("chunks").alias("b").join(newest.select(*keys).alias("n"), named, "left_semi")
            self._recount(change, before, store.upsert(before, newest, keys))
            change.upsert("chunks", newest)

    def delete(self, condition: Column) -> DataFrame:
        """Deletes chunks; returns them."""
        with self.store.transaction() as change:
            gone = change.delete("chunks", condition)
            self._recount(change, gone, gone.limit(0))
            return gone

    def statistics(self, collection: str, doc_ids: object = None) -> DataFrame:
        """term, df, idf, average of a collection, or of these documents of it; no text is read."""
        some = store.collection_scan(self.counts(), collection, doc_ids)
        return lexical.weighted(some.groupBy("term").agg(F.sum("df").alias("df")))
