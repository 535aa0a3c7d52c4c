from lexispark import folders
from lexispark.operators import layout, store


def test_a_scan_opens_few_files(spark):
    rows = [(f"c{i % 3}", f"d{i:04d}", f"{i}_{k}", "x" * k) for i in range(300) for k in range(4)] + [("c1", "big", f"b{k}", "y") for k in range(500)] + [(None, None, "n", "z"), ("c1", None, "m", "z")]
    chunks = spark.createDataFrame(rows, "collection string, doc_id string, chunk_id string, text string").repartition(5)
    held = layout.write_clustered(chunks, folders.new_folder(spark, "clustered"), files=24)
    index = held.index(spark)
    assert index.count() == 24 and sorted(r.chunk_id for r in spark.read.parquet(f"{held.path}/chunks").collect()) == sorted(r[2] for r in rows)
    for collection, docs in (("c0", None), ("c1", ["d0001", "d0100", " "]), ("c1", "d0001"), ("c2", ["d0001"]), ("c1", ["big"]), ("c1", []), ("none", None), ("c1", ["absent"])):
        got = sorted(r.chunk_id for r in held.scan(spark, collection, docs).collect())
        assert got == sorted(r.chunk_id for r in store.collection_scan(chunks, collection, docs).collect())
    assert len(held.files(spark, "c1", ["d0001"])) <= 2 and 2 <= len(held.files(spark, "c1", ["big"])) < 24
    assert held.files(spark, "none") == [] and len(held.files(spark, "c0")) < 12
    # The range alone would let these through; most of them the bits don't.
    absent = [f"d{i:04d}x" for i in range(0, 300, 10)]
    assert sum(bool(held.files(spark, "c1", [d])) for d in absent) <= 3
    plan = held.scan(spark, "c1", ["d0001"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(collection), IsNotNull(doc_id)" in plan or "EqualTo(collection,c1)" in plan


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "collection string, doc_id string, chunk_id string")
    held = layout.write_clustered(none, folders.new_folder(spark, "clustered"))
    assert held.scan(spark, "a").count() == 0 and held.scan(spark, "a").columns == none.columns
