import json
import time

from lexispark.streaming import guard
from lexispark.streaming.ingest import NO_DOCUMENTS, WAITING

DAY = "2024-01-01T{:02d}:{:02d}:00Z"


def event(chat, minute, file=None, progress=None, question=None):
    return {"chat_id": chat, "time": DAY.format(minute // 60, minute % 60), "file_id": file, "progress": progress, "question_id": question}


def test_decisions():
    assert guard.decide({}, 0, 10) == NO_DOCUMENTS
    assert guard.decide({"a": (0.5, 0)}, 10, 10) == WAITING and guard.decide({"a": (0.5, 0)}, 11, 10) == NO_DOCUMENTS
    assert guard.decide({"a": (1.0, 0), "b": (0.5, 0)}, 5, 10) == WAITING and guard.decide({"a": (1.0, 0), "b": (0.5, 0)}, 50, 10) is None


def test_a_stream_of_events_and_questions(spark, tmp_path):
    batches = [
        [event(1, 5, question="q1"), event(1, 0, "a", 0.1), event(2, 1, question="q2"), event(3, 0, "c", 1.0), event(3, 0, question="q3"), event(None, 0, "x", 1.0)],
        [event(1, 10, "a", 1.0), event(1, 10, question="q4"), event(2, 11, "b", 0.3), event(2, 12, question="q5"), event(3, 12, "c"), event(3, 13, question="q6")],
        [event(2, 71, question="q7"), event(2, 72, question="q8"), event(1, 100, question="q9")],
        [event(1, 200, question="q10"), event(2, 201, "b", 1.0), event(2, 202, question="q11")],
    ]
    source = tmp_path / "in"
    source.mkdir()
    for i, listed in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, listed)))
        time.sleep(0.05)
    guard.start_guard(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.question_id: r.message for r in spark.read.schema(guard.DECISIONS).parquet(str(tmp_path / "out")).collect()}
    assert got == {"q1": WAITING, "q2": NO_DOCUMENTS, "q3": None, "q4": None, "q5": WAITING, "q6": NO_DOCUMENTS, "q7": WAITING, "q8": NO_DOCUMENTS, "q9": None, "q10": None, "q11": None}
    # Goes on with its state after a restart.
    (source / "9.json").write_text(json.dumps(event(3, 300, "d", 0.2)) + "\n" + json.dumps(event(3, 301, question="q12")) + "\n" + json.dumps(event(2, 301, question="q13")))
    guard.start_guard(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.question_id: r.message for r in spark.read.schema(guard.DECISIONS).parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 13 and got["q12"] == WAITING and got["q13"] is None
