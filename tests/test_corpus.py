import random

from pyspark.sql import functions as F

from lexispark.operators import corpus, lexical, store

SCHEMA = corpus.CHUNKS


def test_statistics_after_mixed_changes_equal_a_fresh_count(spark, tmp_path):
    rng = random.Random(2)
    words = ["rent", "owner", "form", "x1", "the", "break", "در"]
    row = lambda i, seq: (rng.choice(["a", "b"]), f"c{i}", f"d{i % 4}", rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 9)))]), seq)
    held = corpus.Corpus(spark, f"file://{tmp_path}", buckets=3, most_deltas=3)
    plain = {}

    def put(rows):
        held.upsert(spark.createDataFrame(rows, SCHEMA))
        newest = {}
        for r in rows:
            if (r[0], r[1]) not in newest or r[4] > newest[r[0], r[1]][4]:
                newest[r[0], r[1]] = r
        for key, r in newest.items():
            if key not in plain or r[4] >= plain[key][4]:
                plain[key] = r

    def agree():
        fresh = spark.createDataFrame(list(plain.values()), SCHEMA)
        assert sorted(map(tuple, held.chunks().collect()), key=str) == sorted(plain.values(), key=str)
        for collection, docs in (("a", None), ("b", ["d1", "d2"]), ("none", None)):
            some = store.collection_scan(fresh, collection, docs)
            want = {r.term: (r.df, round(r.idf, 9), round(r.average, 9)) for r in lexical.term_statistics(lexical.tokenised(some, "chunk_id")).collect()}
            got = {r.term: (r.df, round(r.idf, 9), round(r.average, 9)) for r in held.statistics(collection, docs).collect()}
            assert got == want

    put([row(i, 1) for i in range(30)])
    agree()
    # Newer, older and equal ones of the same chunks, another document's chunk with the same key, and fresh ones.
    put([row(i, rng.choice([0, 1, 2])) for i in range(20, 40)] + [("a", "c1", "d9", "moved rent", 5)])
    agree()
    gone = held.delete(F.col("doc_id") == "d2")
    assert gone.count() == sum(r[2] == "d2" for r in plain.values())
    for key in [k for k, r in plain.items() if r[2] == "d2"]:
        plain.pop(key)
    put([row(2, 0), row(6, 0)])
    agree()


def test_a_change_reads_counts_of_its_terms_only(spark, tmp_path):
    held = corpus.Corpus(spark, f"file://{tmp_path}", buckets=4)
    held.upsert(spark.createDataFrame([("a", f"c{i}", f"d{i}", f"w{i} shared", 0) for i in range(50)], SCHEMA))
    deltas = len(held.store.state()["tables"]["counts"]["deltas"])
    held.upsert(spark.createDataFrame([("a", "c1", "d1", "w1 shared", 1)], SCHEMA))
    assert len(held.store.state()["tables"]["counts"]["deltas"]) == deltas
    held.upsert(spark.createDataFrame([("a", "c1", "d1", "w1 other", 2)], SCHEMA))
    folder = held.store.state()["tables"]["counts"]["deltas"][-1][0]
    assert {(r.term, r.df) for r in spark.read.parquet(f"{tmp_path}/{folder}").collect()} == {("shared", 0), ("other", 1)}
