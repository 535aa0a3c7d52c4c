from pyspark.sql import functions as F

from lexispark import schemas
from lexispark.operators import prompt, store
from lexispark.sources import readers
from lexispark.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_context_and_messages(spark):
    chunks = F.array(F.struct(F.lit(" a ").alias("text"), F.lit("d1").alias("doc_id"), F.lit(3).alias("page_number")), F.struct(F.lit("b").alias("text"), F.lit("").alias("doc_id"), F.lit(0).alias("page_number")))
    assert one(spark, prompt.context_block(chunks)) == "[منبع شماره 1 | سند: d1 | شماره صفحه: 3]\na\n\n---\n\n[منبع شماره 2 | سند: نامشخص | شماره صفحه: 0]\nb"
    assert one(spark, prompt.user_message(F.lit(" q "), F.lit("  "))) == "پرسش کاربر:\nq"
    listed = prompt.messages(F.array(prompt.message("user", F.lit(" hi "))), F.lit("now"), "be kind")
    assert one(spark, prompt.chatml(listed)) == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>user\nnow<|im_end|>\n<|im_start|>assistant\n"


def test_history(spark):
    rows = [(i, 1, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(6)] + [(6, 1, "system", "no"), (7, 1, "user", ""), (8, 1, "user", "  ")]
    df = spark.createDataFrame(rows, "id int, chat_id int, role string, content string")
    assert [r.content for r in prompt.history_tail(df, 2).orderBy("id").collect()] == ["m3", "m4", "m5", ""]
    assert prompt.history_tail(df, 0).count() == 7 == prompt.history_tail(df, -1).count()


def test_answers(spark):
    df = spark.createDataFrame([(1, "a  b"), (2, "")], "id int, answer string")
    tokens = prompt.answer_tokens(df, "id")
    assert [r.token for r in tokens.where("id = 1").orderBy("position").collect()] == ["a ", " ", "b "]
    assert {r.id: r.answer for r in prompt.joined_answer(tokens, "id").collect()} == {1: "a  b", 2: ""}


def test_citations(spark):
    df = spark.createDataFrame([("d", 2, "t", 0.92, 0.01), ("e", 1, "x" * 150, None, 0.0164)], "doc_id string, page_number int, text string, similarity double, score double")
    got = df.select(*prompt.citation_columns()).collect()
    assert [(r.filename, r.score, len(r.snippet)) for r in got] == [("d", 0.92, 1), ("e", 0.016, 143)]


def test_store(spark, tmp_path):
    schema = "collection string, chunk_id string, doc_id string, seq long"
    old = spark.createDataFrame([("c", "1", "a", 0), ("c", "2", "b", 0)], schema)
    new = spark.createDataFrame([("c", "2", "b2", 1), ("d", "2", "b", 1)], schema)
    merged = store.upsert(old, new, ["collection", "chunk_id"])
    assert sorted(r.doc_id for r in merged.collect()) == ["a", "b", "b2"]
    assert store.delete(merged, F.col("doc_id") == "b2").count() == 2
    table = store.Table(spark, f"file://{tmp_path}/t", schema)
    assert table.read().count() == 0
    table.replace(merged)
    table.replace(store.delete(table.read(), F.col("doc_id") == "a"))
    assert table.read().count() == 2


def test_table_operations(spark, tmp_path):
    table = store.Table(spark, f"file://{tmp_path}/files", "id long, collection string, name string, updated_at timestamp")
    table.truncate()
    assert table.read().count() == 0
    table.replace(spark.sql("SELECT id, concat('c', id % 2) AS collection, concat('n', id) AS name, timestamp'2024-01-01' AS updated_at FROM range(6)"))
    gone = table.delete(F.col("id") < 2)
    assert sorted(r.name for r in gone.collect()) == ["n0", "n1"] and table.read().count() == 4
    table.update(F.col("id") == 3, name=F.lit("renamed"))
    rows = {r.id: r for r in table.read().collect()}
    assert rows[3].name == "renamed" and rows[3].updated_at > rows[4].updated_at and rows[4].name == "n4"
    assert table.drop_collections() == 2 and table.read().count() == 0


def test_equal_seq_is_decided(spark):
    schema = "k string, v string, seq long"
    old, new = spark.createDataFrame([("a", "old", 1)], schema), spark.createDataFrame([("a", f"new{i}", 1) for i in range(5)], schema)
    got = {store.upsert(old, new.repartition(n, "v"), ["k"]).first().v for n in (1, 2, 3)}
    assert len(got) == 1 and got.pop().startswith("new")


def test_model_switch_clears(spark, tmp_path):
    chunks = store.Table(spark, f"file://{tmp_path}/chunks", "collection string")
    chats = store.Table(spark, f"file://{tmp_path}/chats", "id long")
    passport = f"file://{tmp_path}/passport"
    fill = lambda: (chunks.replace(spark.createDataFrame([("a",)], "collection string")), chats.replace(spark.range(2)))
    fill()
    for wanted, effect, left in (("bge-m3", "written", 2), ("bge-m3", "nothing", 2), ("none", "rejected", 2), ("e5-small", "cleared", 0)):
        assert store.switch_model(spark, wanted, passport, chunks, [chats]) == effect and chats.read().count() == left
    assert chunks.read().count() == 0 and readers.read_passport(spark, passport) == "e5-small"
    row = spark.read.schema(schemas.PASSPORT).json(passport).first()
    assert row.dimension == 384 and row.description == readers.DESCRIPTIONS["e5-small"]


def test_documents_sink(spark, tmp_path):
    pages = spark.createDataFrame([("d", "f", "real", 2, "b"), ("d", "f", "real", 1, "a"), ("e", "g", "mock", 1, None)], "doc_id string, filename string, source_type string, page_number int, raw_text string")
    readers.write_documents(pages, str(tmp_path / "out"))
    back = readers.pages_of(spark.read.schema(schemas.DOCUMENT).json(str(tmp_path / "out")))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, pages.collect()), key=str)


def test_streaming_upsert(spark, tmp_path):
    import json

    schema = "chunk_id string, text string, seq long"
    source, table = tmp_path / "in", store.Table(spark, f"file://{tmp_path}/t", schema, ["chunk_id"], order="seq", buckets=4)
    source.mkdir()
    for i, rows in enumerate([[("1", "a", 0), ("2", "b", 0)], [("2", "B", 1), ("3", "c", 1)], []]):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("chunk_id", "text", "seq"), r, strict=True))) for r in rows))
        ingest.start_ingest(spark, str(source), schema, table, str(tmp_path / "cp")).awaitTermination()
    assert {r.chunk_id: r.text for r in table.read().collect()} == {"1": "a", "2": "B", "3": "c"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\fpage two\f")
    got = readers.scan_files(spark, str(tmp_path), lambda raw: raw.decode().split("\f")).orderBy("page_number").collect()
    assert [(r.filename, r.page_number, r.raw_text) for r in got] == [("a.pdf", 1, "one"), ("a.pdf", 2, "page two"), ("a.pdf", 3, "")]
    (tmp_path / "d.json").write_text('[{"doc_id": "x", "filename": "f", "source_type": "real", "pages": [{"page_number": 1, "raw_text": "t"}]}]')
    assert readers.pages_of(readers.read_json(spark, str(tmp_path / "d.json"), schemas.DOCUMENT)).first().raw_text == "t"
    (tmp_path / "l.json").write_text('{"doc_id": "x", "pages": []}\n{"doc_id": "y", "pages": [{"page_number": 1, "raw_text": null}]}\n')
    assert [tuple(r)[0::4] for r in readers.pages_of(readers.read_json(spark, str(tmp_path / "l.json"), schemas.DOCUMENT, lines=True)).collect()] == [("y", None)]
    assert readers.read_passport(spark, str(tmp_path / "none")) is None
    readers.write_passport(spark, str(tmp_path / "p"), "bge-m3")
    assert readers.read_passport(spark, str(tmp_path / "p")) == "bge-m3"
    assert one(spark, readers.html_text(F.lit("<p>a <b>b</b><script>x</script> c"))) == "a b c"
