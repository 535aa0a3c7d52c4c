"""Incremental ingest: a stream of chunk files is upserted into a table, batch by batch."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from ..functions.text import chunk_id, clean
from ..operators.chunking import chunk_documents
from ..operators.retrieve import Embed, embed_chunks
from ..operators.store import Table

# Stages of an ingest with their progress, and messages of the guards.
STAGES = (
    ("در حال خواندن فایل PDF...", 0.10),
    ("استخراج متن و پاکسازی صفحات...", 0.30),
    ("قطعه‌بندی معنایی متن سند (چانک‌بندی)...", 0.55),
    ("تولید بردارها با مدل هوش مصنوعی...", 0.80),
    ("نمایه‌سازی در پایگاه داده برداری...", 0.95),
    ("تکمیل پردازش اسناد", 1.00),
)
WAITING = "⚠️ در حال پردازش اسناد .... لطفاً منتظر بمانید"
NO_DOCUMENTS = "⚠️ هنوز هیچ سندی به این گفتگو اضافه نشده است."


def start_ingest(spark: SparkSession, source: str, schema: str | StructType, table: Table, checkpoint: str) -> StreamingQuery:
    """JSON files that appear in ``source`` are upserted into a keyed ``table``, each batch as one delta.

    A batch's number is committed with its rows, so a batch that is run again changes nothing.
    """
    stream = spark.readStream.schema(schema).json(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, stream=checkpoint, batch=batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Rows that a stage of a run has passed on: batch, stage (place in ``STAGES``), documents of the batch, and of all batches so far.
PROGRESS = "batch long, stage int, message string, documents long, done long, progress double"


def share_of(stage: Column, done: Column, total: Column) -> Column:
    """How far a run is when a stage has passed on ``done`` of ``total`` documents: from the share of the stage before it to its own."""
    shares = F.array(*(F.lit(share) for _, share in STAGES))
    before = F.when(stage > 0, F.get(shares, stage - 1)).otherwise(F.lit(0.0))
    return F.round(before + (F.get(shares, stage) - before) * F.when(total > 0, F.least(done / total, F.lit(1.0))).otherwise(1.0), 4)


class _Observed(StreamingQueryListener):
    """Keeps what the stages of one query observed, batch by batch."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int]] = []
        self.name: str | None = None
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for name, row in event.progress.observedMetrics.items():
            if event.progress.name == self.name and name.startswith("stage"):
                self.rows.append((event.progress.batchId, int(name[5:]), int(row.documents or 0)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()


def ingest_with_progress(spark: SparkSession, source: str, schema: str | StructType, table: Table, checkpoint: str, *, total: int, embed: Embed, files_a_batch: int = 1, model_key: str = "e5-small") -> DataFrame:
    """Documents (collection, doc_id, text, seq) that appear as JSON files in ``source`` are cleaned, cut into chunks, embedded and upserted into
    ``table`` (collection, chunk_id, doc_id, text, embedding, seq). Returns ``PROGRESS`` of the run.

    Each stage counts the documents that pass through it while they do, so a share is that of rows which were processed, of ``total`` expected ones.
    """
    counted = lambda rows, stage, whole=F.lit(True): rows.observe(f"stage{stage}", F.sum(F.when(whole, 1).otherwise(0)).alias("documents"))
    heard = _Observed()
    heard.name = f"ingest-{uuid.uuid4().hex}"
    read = counted(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(source), 0)
    cleaned = counted(read.withColumn("text", clean(F.coalesce("text", F.lit("")))), 1)
    # A document without text has one chunk, the empty one, so that it passes through all stages.
    page = F.struct(F.lit(1).alias("page_number"), F.when(F.length("text") > 0, F.col("text")).otherwise(F.lit(" ")).alias("text"))
    keyed = cleaned.select(F.struct("collection", "doc_id", "seq").alias("doc_id"), F.array(page).alias("pages"))
    cut = chunk_documents(keyed.select(F.to_json("doc_id").alias("doc_id"), "pages")).select("doc_id", "chunk_index", "text")
    of = F.from_json("doc_id", "collection string, doc_id string, seq long")
    chunks = cut.select(of.alias("of"), "chunk_index", "text").select("of.*", "chunk_index", "text").withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index")))
    first = F.col("chunk_index") == 0
    chunks = counted(chunks, 2, first)
    embedded = counted(embed_chunks(chunks, embed, model_key=model_key), 3, first)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch.select(*table.read().columns), stream=checkpoint, batch=batch_id)

    spark.streams.addListener(heard)
    try:
        query = embedded.writeStream.queryName(heard.name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        heard.ended.wait(60)
    finally:
        spark.streams.removeListener(heard)
    return progress_of(spark, heard.rows, total)


def progress_of(spark: SparkSession, observed: list[tuple[int, int, int]], total: int) -> DataFrame:
    """``PROGRESS`` from (batch, stage, documents). What the last observed stage passed on is upserted in the same commit, which ends the run's last two stages."""
    stages = sorted({s for _, s, _ in observed})
    more = [(b, s, n) for b, stage, n in observed if stages and stage == stages[-1] for s in range(stage + 1, len(STAGES))]
    rows = spark.createDataFrame([*observed, *more], "batch long, stage int, documents long")
    so_far = F.sum("documents").over(Window.partitionBy("stage").orderBy("batch"))
    done = rows.withColumn("done", so_far).withColumn("message", F.get(F.array(*(F.lit(m) for m, _ in STAGES)), F.col("stage")))
    return done.select("batch", "stage", "message", "documents", "done", share_of(F.col("stage"), F.col("done"), F.lit(total)).alias("progress"))


def progress(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, message, share) for i, (message, share) in enumerate(STAGES)], "stage int, message string, progress double")


def guard(progress_share: Column, n_files: Column) -> Column:
    """The message that stands in for an answer while documents are missing or in work, else null."""
    return F.when(F.coalesce(n_files, F.lit(0)) == 0, NO_DOCUMENTS).when(progress_share < 1.0, WAITING)
