"""Collections clustered on disk, with an index of what each file can hold.

Chunks lie sorted by (collection, doc_id) in files of ranges of these, so a document's chunks are in one file or two. An index beside them has a row a file: its
collections' and documents' least and greatest values and 4,096 Bloom bits of its documents. A scan looks into the index first and opens
only files that may hold what it asks for; the filter itself stays in the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .dense import id_filter

#: 64-bit words of a file's Bloom bits, and bits that one document sets.
WORDS, MARKS = 64, 3


def _marks(collection: Column, doc_id: Column) -> Column:
    """The bits of a document, as an array of numbers below 64 * WORDS."""
    return F.array(*(F.pmod(F.xxhash64(collection, doc_id, F.lit(i)), F.lit(64 * WORDS)).cast("int") for i in range(MARKS)))


@dataclass
class Clustered:
    path: str
    schema: StructType

    def index(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/index")

    def files(self, spark: SparkSession, collection: str, doc_ids: list[str] | None = None) -> list[str]:
        """The files that may hold chunks of a collection, or of these documents of it."""
        own = self.index(spark).where((F.col("least.collection") <= collection) & (F.col("greatest.collection") >= collection))
        if doc_ids is not None:
            wanted = F.array(*map(F.lit, doc_ids))
            place = lambda d: F.struct(F.lit(collection).alias("collection"), d.alias("doc_id"))
            marked = lambda d: F.forall(_marks(F.lit(collection), d), lambda m: F.getbit(F.get("bits", F.floor(m / 64).cast("int")), m % 64) == 1)
            own = own.where(F.exists(wanted, lambda d: (F.col("least") <= place(d)) & (place(d) <= F.col("greatest")) & marked(d)))
        return sorted(r.file for r in own.select("file").collect())

    def scan(self, spark: SparkSession, collection: str, doc_ids: object = None) -> DataFrame:
        """The chunks of a collection, of these documents where any are named. A collection that isn't there is empty."""
        only = id_filter("doc_id", doc_ids)
        listed = None
        if only is not None:
            listed = [doc_ids] if isinstance(doc_ids, (str, bytes)) or not hasattr(doc_ids, "__iter__") else [i for i in doc_ids if str(i).strip()]
        files = self.files(spark, collection, None if listed is None else [str(i) for i in listed])
        if not files:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(self.schema).parquet(*files).where(F.col("collection") == collection)
        return rows if only is None else rows.where(only)


def write_clustered(chunks: DataFrame, path: str, *, files: int | None = None) -> Clustered:
    """Writes chunks (collection and doc_id as strings, and other columns) at ``path``, in as many files as there are shuffle partitions if not said otherwise.

    The ranges are of (collection, doc_id) and a hash, so a document that holds a great share of all chunks is dealt over several files.
    """
    spark = chunks.sparkSession
    order = ["collection", "doc_id", F.xxhash64(*[c for c in chunks.columns if c not in ("collection", "doc_id")] or [F.lit(0)])]
    dealt = chunks.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions("collection", "doc_id")
    dealt.write.mode("overwrite").parquet(f"{path}/chunks")
    place = F.struct(F.coalesce("collection", F.lit("")).alias("collection"), F.coalesce("doc_id", F.lit("")).alias("doc_id"))
    documents = spark.read.schema(chunks.schema).parquet(f"{path}/chunks").select(F.input_file_name().alias("file"), "collection", "doc_id", place.alias("place")).distinct()
    ends = documents.groupBy("file").agg(F.min("place").alias("least"), F.max("place").alias("greatest"), F.count(F.lit(1)).alias("documents"))
    marks = documents.select("file", F.explode(_marks(F.col("collection"), F.col("doc_id"))).alias("m"))
    words = marks.groupBy("file", F.floor(F.col("m") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, m % 64)")).alias("bits"))
    listed = words.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.try_element_at("held", w), F.lit(0).cast("long")))
    ends.join(listed, "file").select("file", "least", "greatest", "documents", bits.alias("bits")).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    return Clustered(path, chunks.schema)
