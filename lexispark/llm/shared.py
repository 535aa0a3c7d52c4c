"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import new_folder

#: Spark's setting for shuffle files to be removed when the query that made them ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes ``df`` as a table in the shared folder, which cuts its lineage; returns it read back, and its folder.

    A lost executor costs the tasks that it ran, not what led to the table. The shuffle files behind
    the table go as soon as it is written, instead of when the driver next collects garbage.
    """
    spark = df.sparkSession
    folder = new_folder(spark, label)
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(folder), folder


def discard(spark: SparkSession, *folders: str) -> None:
    """Deletes tables or files that no later plan reads."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: 64-bit words of the largest filter: 8 MB.
MOST_WORDS = 1 << 20


def may_hold(wanted: DataFrame, key: str, n: int) -> Column:
    """A condition that holds for every ``key`` (a 64-bit hash) among the ``n`` wanted ones, and for few others.

    One bit for each key in a table of 16 bits a key, of ``MOST_WORDS`` words at most, so that its size is bounded; a
    table that is too full lets more rows through, and the join behind it tells these apart.
    """
    words = min(MOST_WORDS, 1 << max(6, (n // 4).bit_length()))
    bit = F.pmod(F.col(key), F.lit(words * 64))
    marked = wanted.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    every = wanted.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    table = marked.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
    word = F.element_at(table.scalar(), (F.shiftright(bit, 6) + 1).cast("int"))
    return F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))").bitwiseAND(word) != 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc32_of_id(column: str):
    """crc32 of an id written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
