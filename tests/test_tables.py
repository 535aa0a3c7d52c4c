import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexispark.operators import store
from lexispark.streaming import ingest

ROWS = "id long, name string, seq long"


def rows(spark, listed):
    return spark.createDataFrame(listed, ROWS)


def state(table):
    return {r.id: r.name for r in table.read().collect()}


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_an_upsert_writes_only_its_buckets(spark, tmp_path):
    table = store.Table(spark, f"file://{tmp_path}", ROWS, ["id"], order="seq", buckets=32)
    table.replace(rows(spark, [(i, f"n{i}", 0) for i in range(1000)]))
    before = files(tmp_path)
    assert len({f.split("/")[1] for f in before}) == 32
    table.upsert(rows(spark, [(i, "new", 1) for i in range(10)]))
    after = files(tmp_path)
    assert before.items() <= after.items() and 1 <= len(after) - len(before) <= 10
    assert state(table) == {i: "new" if i < 10 else f"n{i}" for i in range(1000)}
    # The compaction rewrites the buckets that have deltas, and leaves the files of all others.
    changed = table.store.compact("rows")
    assert len(changed) == len(after) - len(before) and after.items() <= files(tmp_path).items()
    assert {f.split("/")[1] for f in files(tmp_path).keys() - after.keys()} == {f"bucket={b}" for b in changed}
    assert state(table) == {i: "new" if i < 10 else f"n{i}" for i in range(1000)} and not table.store.state()["tables"]["rows"]["deltas"]


def test_mixed_changes_equal_a_plain_table(spark, tmp_path):
    """Upserts with higher, equal and lower order, deletes, updates and compactions in turn."""
    table = store.Table(spark, f"file://{tmp_path}", ROWS, ["id"], order="seq", buckets=3, most_deltas=4)
    plain = {}

    def put(listed):
        table.upsert(rows(spark, listed))
        for i, name, seq in listed:
            if i not in plain or seq >= plain[i][1]:
                plain[i] = (name, seq)

    put([(i, f"a{i}", 5) for i in range(20)])
    put([(1, "low", 4), (2, "high", 6), (3, "equal", 5), (30, "fresh", 0)])
    gone = table.delete(F.col("id").isin(2, 4, 5))
    assert {r.id for r in gone.collect()} == {2, 4, 5}
    for i in (2, 4, 5):
        plain.pop(i)
    put([(2, "back", 1)])
    table.update(F.col("id") < 3, name=F.lit("u"), seq=F.lit(0).cast("long"))
    plain |= {i: ("u", 0) for i in plain if i < 3}
    put([(0, "after", 0)])
    assert {r.id: (r.name, r.seq) for r in table.read().collect()} == plain
    for n in range(6):
        put([(n, f"b{n}", 9), (100 + n, "x", n)])
        assert {r.id: (r.name, r.seq) for r in table.read().collect()} == plain
    assert all(len([1 for _, b in table.store.state()["tables"]["rows"]["deltas"] if k in b]) <= 5 for k in "012")
    table.truncate()
    assert state(table) == {}
    put([(1, "again", 0)])
    assert state(table) == {1: "again"}
    table.upsert(rows(spark, []))
    assert state(table) == {1: "again"}


def test_keys_that_repeat_and_keyless_tables(spark, tmp_path):
    table = store.Table(spark, f"file://{tmp_path}/a", ROWS, ["id"], order="seq")
    table.replace(rows(spark, [(1, "x", 0), (1, "y", 3), (None, "null", 0), (None, "null 2", 1)]))
    assert state(table) == {1: "y", None: "null 2"}
    plain = store.Table(spark, f"file://{tmp_path}/b", ROWS)
    plain.replace(rows(spark, [(1, "x", 0), (1, "x", 0), (2, "y", 0)]))
    assert plain.read().count() == 3
    plain.update(F.col("id") == 2, name=F.lit("z"))
    assert plain.delete(F.col("id") == 1).count() == 2 and state(plain) == {2: "z"}
    with pytest.raises(ValueError):
        plain.upsert(rows(spark, [(1, "x", 0)]))
    with pytest.raises(ValueError):
        table.update(F.col("id") == 1, id=F.lit(2))


def test_a_failure_leaves_the_old_state(spark, tmp_path):
    table = store.Table(spark, f"file://{tmp_path}", "id long", keep=3)
    table.replace(spark.range(3))
    with pytest.raises(Exception, match="no"):
        table.replace(spark.range(3).withColumn("id", F.raise_error(F.lit("no")).cast("long")))
    with pytest.raises(ZeroDivisionError), table.store.transaction() as change:
        change.replace("rows", spark.range(9))
        1 / 0
    (tmp_path / "next-state-of-a-writer-that-was-lost").write_text("{")
    assert table.read().count() == 3 and len([f for f in tmp_path.iterdir() if f.name.startswith("base-") and any(f.iterdir())]) <= 2
    held = table.read()
    for n in (5, 7):
        table.replace(spark.range(n))
    assert table.read().count() == 7 and held.count() == 3
    for n in range(4):
        table.replace(spark.range(n))
    assert len(list(tmp_path.glob("CURRENT-*"))) == 3 and not (tmp_path / held.inputFiles()[0].split("/")[-3]).exists()


def test_two_writers(spark, tmp_path):
    spec = {"a": store.Spec(ROWS, ("id",), "seq", 4), "b": store.Spec(ROWS, ("id",), "seq", 4)}
    one, two = (store.Store(spark, f"file://{tmp_path}", spec) for _ in range(2))
    one.table("a").replace(rows(spark, [(1, "x", 0)]))
    # Rows that are only added don't depend on what others did.
    with one.transaction() as change:
        change.upsert("a", rows(spark, [(2, "one", 0)]))
        two.table("a").upsert(rows(spark, [(3, "two", 0)]))
        two.table("b").replace(rows(spark, [(9, "b", 0)]))
    assert state(one.table("a")) == {1: "x", 2: "one", 3: "two"} and state(one.table("b")) == {9: "b"}
    # What was read must not have changed; a change of another table does no harm.
    with one.transaction() as change:
        change.delete("a", F.col("id") == 1)
        two.table("b").upsert(rows(spark, [(10, "b", 0)]))
    assert state(one.table("a")) == {2: "one", 3: "two"}
    with pytest.raises(store.Conflict), one.transaction() as change:
        change.delete("a", F.col("id") == 2)
        two.table("a").upsert(rows(spark, [(2, "newer", 1)]))
    assert state(one.table("a")) == {2: "newer", 3: "two"}


def test_a_name_is_given_once(spark, tmp_path):
    held = store.Store(spark, f"file://{tmp_path}", {})
    won = []
    for i in range(8):
        held._put(f"next-{i}", str(i))
    threads = [threading.Thread(target=lambda i=i: won.append((i, held._give_name(f"next-{i}", "CURRENT-000000000000")))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    first = [i for i, ok in won if ok]
    assert len(won) == 8 and len(first) == 1 and (tmp_path / "CURRENT-000000000000").read_text() == str(first[0]) and not list(tmp_path.glob("next-*"))


def test_a_chat_goes_with_all_that_is_its(spark, tmp_path):
    child = lambda name: store.Spec(f"id long, {name} long", ("id",), None, 4)
    held = store.Store(spark, f"file://{tmp_path}", {"chats": store.Spec("id long, title string", ("id",), None, 4), "messages": child("chat_id"), "files": child("chat"), "chunks": store.Spec("text string, chat_id long")})
    held.table("chats").replace(spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, title string"))
    held.table("messages").replace(spark.range(50).select("id", (F.col("id") % 5).alias("chat_id")))
    held.table("files").replace(spark.range(10).select("id", (F.col("id") % 5).alias("chat")))
    held.table("chunks").replace(spark.range(20).select(F.lit("x").alias("text"), (F.col("id") % 5).alias("chat_id")))
    number, children = held.state()["number"], {"messages": "chat_id", "files": "chat", "chunks": "chat_id"}
    count = lambda: [held.table(n).read().count() for n in ("chats", *children)]
    with pytest.raises(Exception, match="nowhere"):
        store.delete_chats(held, F.col("id") < 2, children | {"chunks": "nowhere"})
    assert count() == [5, 50, 10, 20] and held.state()["number"] == number
    gone = store.delete_chats(held, F.col("id") < 2, children)
    assert sorted(r.title for r in gone.collect()) == ["t0", "t1"]
    assert count() == [3, 30, 6, 12] and held.state()["number"] == number + 1


def test_a_batch_that_is_run_again(spark, tmp_path):
    table = store.Table(spark, f"file://{tmp_path}", ROWS, ["id"], order="seq", buckets=2)
    table.upsert(rows(spark, [(1, "x", 0)]), stream="s", batch=0)
    table.delete(F.col("id") == 1)
    table.upsert(rows(spark, [(1, "x", 0)]), stream="s", batch=0)
    assert state(table) == {}
    table.upsert(rows(spark, [(1, "y", 0)]), stream="s", batch=1)
    assert state(table) == {1: "y"}


def test_ids_in_parallel(spark):
    new = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("v"))
    got = store.next_ids(spark.createDataFrame([(41,)], "id long"), new, ["k"])
    listed = sorted((r.id, r.k) for r in got.collect())
    assert [i for i, _ in listed] == list(range(42, 5042)) and [k for _, k in listed] == sorted(k for _, k in listed)
    assert "SinglePartition" not in got.select("id")._jdf.queryExecution().executedPlan().toString().split("Window")[0].split("numbered")[0]
    assert store.next_ids(spark.createDataFrame([], "id long"), new.limit(0), ["k"]).count() == 0


def test_a_row_by_its_keys(spark, tmp_path):
    table = store.Table(spark, f"file://{tmp_path}", ROWS, ["id"], order="seq", buckets=8)
    table.replace(rows(spark, [(i, f"n{i}", 0) for i in range(100)] + [(None, "null", 0)]))
    table.upsert(rows(spark, [(5, "new", 1)]))
    assert [r.name for r in table.get(id=5).collect()] == ["new"] and [r.name for r in table.get(id=None).collect()] == ["null"]
    assert table.get(id=1000).count() == 0 and len({f.split("bucket=")[1].split("/")[0] for f in table.get(id=7).inputFiles()}) == 1
    with pytest.raises(ValueError):
        table.get(name="x")


def test_ranks_without_a_cut(spark):
    ranking = spark.range(3000).select("id", (F.col("id") % 70).alias("score"))
    wanted = spark.createDataFrame([(0,), (69,), (2999,), (5000,), (69,)], "id long")
    got = sorted((r.id, r.place) for r in store.ranks_of(wanted, ranking, [F.desc("score"), F.asc("id")], "id").collect())
    order = sorted(range(3000), key=lambda i: (-(i % 70), i))
    place = {i: n + 1 for n, i in enumerate(order)}
    assert got == [(i, place.get(i)) for i in (0, 69, 69, 2999, 5000)]


def test_scan_of_a_collection(spark):
    df = spark.createDataFrame([("a", "d1"), ("a", "d2"), ("b", "d1")], "collection string, doc_id string")
    count = lambda *x: store.collection_scan(df, *x).count()
    assert (count("a"), count("a", []), count("a", ["d1", " "]), count("none"), count("b", "d2")) == (2, 2, 1, 0, 0)


def test_progress_is_that_of_rows(spark, tmp_path):
    """Three files are three batches; each stage's share follows the documents that have passed it."""
    for n, listed in enumerate([[("a", "d1", "one two " * 30, 0), ("a", "d2", "", 0)], [("a", "d3", None, 1)], [("a", "d1", "new text", 2), ("b", "d1", "x", 2)]]):
        spark.createDataFrame(listed, "collection string, doc_id string, text string, seq long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        assert n < 3
    schema = "collection string, chunk_id string, doc_id string, text string, embedding array<float>, seq long"
    table = store.Table(spark, f"file://{tmp_path}/t", schema, ["collection", "chunk_id"], order="seq", buckets=2)
    told = ingest.ingest_with_progress(spark, str(tmp_path / "in"), "collection string, doc_id string, text string, seq long", table, str(tmp_path / "cp"), total=5, embed=lambda texts: [[1.0, float(len(t))] for t in texts])
    rows_ = sorted((r.batch, r.stage, r.documents, r.done, r.progress, r.message) for r in told.collect())
    assert len(rows_) == 18 and [r[2] for r in rows_ if r[1] == 0] and sum(r[2] for r in rows_ if r[1] == 4) == 5
    final = {r[1]: r for r in rows_ if r[0] == max(x[0] for x in rows_)}
    assert [final[s][4] for s in range(6)] == [0.1, 0.3, 0.55, 0.8, 0.95, 1.0] and final[5][5] == ingest.STAGES[5][0]
    early = {r[1]: r for r in rows_ if r[0] == 0}
    assert all(early[s][3] == early[0][3] < 5 for s in range(6)) and early[1][4] == round(0.1 + 0.2 * early[0][3] / 5, 4)
    kept = {(r.collection, r.chunk_id): r.text for r in table.read().collect()}
    assert kept["a", "d1_c000"] == "new text" and kept["b", "d1_c000"] == "x" and kept["a", "d2_c000"] == kept["a", "d3_c000"] == ""
    again = ingest.ingest_with_progress(spark, str(tmp_path / "in"), "collection string, doc_id string, text string, seq long", table, str(tmp_path / "cp"), total=5, embed=lambda texts: [[1.0] for _ in texts])
    assert again.count() == 0
