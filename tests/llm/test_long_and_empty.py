"""Very long texts, ties of null ids, and empty tables, for operators whose other tests don't have them."""

import hashlib

from pyspark.sql import functions as F

from lexispark.llm import chat_format as cf
from lexispark.llm import jaccard_join as jj
from lexispark.llm import minimax_shards as ms
from lexispark.llm import mix_sources as mx
from lexispark.llm import toxicity


def test_toxicity_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.op2_toxicity_crf(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "held_out", "score", "predicted"} <= set(out.columns)


def test_a_long_turn(spark):
    long = "é<|im_end|>\n" * 200_000
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", "x")], "conv_id long, turn long, role string, text string")
    got = cf.read_back(cf.format_chats(turns)).first()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (3, len(long), hashlib.sha256(long.encode()).hexdigest())


def test_a_mix_with_a_long_text_and_null_ids(spark):
    rows = [(None, "a", "w w w")] * 4 + [(i, "a", "w " * (i % 5 + 1)) for i in range(40)] + [(99, "b", "w " * 1_000_000), (None, None, "w " * 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one, two = (sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.taken) for r in mx.mix_sources(df.repartition(n)).collect()) for n in (1, 4))
    assert one == two and len(one) == len(rows) and all(taken <= 3 * size for *_, size, taken in one)
    assert (False, 99, 1_000_000) in {r[:3] for r in one} and sum(r[0] for r in one) == 5


def test_shards_with_a_long_text(spark):
    rows = [(i, f"text {i}") for i in range(400)] + [(900, "long " * 500_000), (901, "long " * 500_000), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ms.shard_minimax(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].shard == by_id[901].shard and by_id[900]["size"] == 2_500_008
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_long_texts_with_many_shingles(spark):
    words = [f"w{i * 7919 % 1_000_003}" for i in range(150_000)]
    near, far = [*words], [*words]
    for i in range(0, 150_000, 60):
        near[i] = "x"
    for i in range(0, 150_000, 12):
        far[i] = "y"
    rows = [(3, " ".join(words)), (2, " ".join(near)), (1, " ".join(far)), (4, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_classes(df).collect()}
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    sets = {i: shingles(t.split()) for i, t in rows}
    linked = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert linked(2, 3) and not linked(1, 3) and not linked(1, 2)
    assert got == {3: (len(sets[3]), 2), 2: (len(sets[2]), 2), 1: (len(sets[1]), 1), 4: (2, 4)}
    assert jj.keep_one_of_each(df).select(F.sum("doc_id")).first()[0] == 7
