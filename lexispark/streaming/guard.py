"""The guard of questions as a stateful stream: ingest events and questions of all chats, in order of their time.

Each chat's state is how far each of its files is and when it was last heard of. A question is held back while a file of its chat is in work, or
where the chat has none. A file that isn't heard of for ``lost_after`` is lost: it counts as no file from then on, and a
timer takes it out of the state. Events of a chat within a batch are taken by time, progress before questions of the same time; what
comes in a later batch is later, so answers that were given stay.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .ingest import NO_DOCUMENTS, WAITING

#: A file's progress (file_id, progress from 0 to 1; null: the file was deleted) or a question (question_id) of a chat.
EVENTS = "chat_id long, time timestamp, file_id string, progress double, question_id string"
DECISIONS = "chat_id long, question_id string, message string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decide(files: dict[str, tuple[float, float]], now: float, lost_after: float) -> str | None:
    """The message that stands in for an answer at a time, if there is one. ``files``: progress, and when it was told."""
    known = [p for p, heard in files.values() if p >= 1.0 or now - heard <= lost_after]
    if not known:
        return NO_DOCUMENTS
    return WAITING if min(known) < 1.0 else None


class GuardProcessor(StatefulProcessor):
    def __init__(self, lost_after: float):
        self.lost_after = lost_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file_id string", "progress double, heard double")

    def _held(self) -> dict[str, tuple[float, float]]:
        return {key[0]: (value[0], value[1]) for key, value in self.files.iterator()} if self.files.exists() else {}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self._held()
        for row in sorted(rows, key=lambda r: (r.time.timestamp(), r.question_id is not None, r.file_id or "", r.question_id or "")):
            now = row.time.timestamp()
            if row.question_id is not None:
                yield Row(chat_id=key[0], question_id=row.question_id, message=decide(held, now, self.lost_after))
            elif row.file_id is not None and row.progress is None:
                if held.pop(row.file_id, None) is not None and self.files.containsKey((row.file_id,)):
                    self.files.removeKey((row.file_id,))
            elif row.file_id is not None:
                held[row.file_id] = (row.progress, now)
                self.files.updateValue((row.file_id,), (row.progress, now))
                if row.progress < 1.0:
                    self.handle.registerTimer(int((now + self.lost_after) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        for name, (progress, heard) in self._held().items():
            if progress < 1.0 and now - heard > self.lost_after:
                self.files.removeKey((name,))
        return iter(())

    def close(self) -> None:
        pass


def decisions(events: DataFrame, *, lost_after: float = 3600.0, late: str = "0 seconds") -> DataFrame:
    """``DECISIONS`` of a stream of ``EVENTS``; the session must keep state in RocksDB."""
    timed = events.where("chat_id is not null and time is not null").withWatermark("time", late)
    return timed.groupBy("chat_id").transformWithState(GuardProcessor(lost_after), DECISIONS, "Append", "EventTime")


def start_guard(spark: SparkSession, source: str, sink: str, checkpoint: str, *, lost_after: float = 3600.0, files_a_batch: int = 1) -> StreamingQuery:
    """Events that appear as JSON files in ``source`` become decisions in ``sink`` (Parquet), file by file in the order of their writing."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).json(source)
        return decisions(events, lost_after=lost_after).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
