import asyncio
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import chunking, dense, fusion, lexical, prompt, retrieve
from lexispark.sources import synthetic

CHUNKS = [("doc1_c001", "contract_101", "The rent is paid each month to the owner"), ("doc1_c002", "contract_101", "Force majeure frees both sides"), ("doc2_c001", "rules_202", "Form code 98234-b is handed in first"), ("doc2_c002", "rules_202", "Breaks are at noon for all staff members")]


def okapi(corpus, query, k1=1.5, b=0.75, eps=0.25):
    n, average = len(corpus), sum(map(len, corpus)) / len(corpus)
    df = {}
    for words in corpus:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: eps * mean if v < 0 else v for w, v in idf.items()}
    return [sum(idf.get(q, 0) * words.count(q) * (k1 + 1) / (words.count(q) + k1 * (1 - b + b * len(words) / average)) for q in query) for words in corpus]


def test_bm25_against_plain(spark):
    df = spark.createDataFrame(CHUNKS, "doc_id string, source string, text string")
    words = lexical.tokenised(df, stopwords=False)
    query = ["98234", "b", "the", "the", "absent"]
    expected = {i: s for (i, _, t), s in zip(CHUNKS, okapi([t.lower().replace("-", " ").split() for _, _, t in CHUNKS], query)) if s > 0}
    got = {r.id: r.score for r in lexical.scores(words, query).collect()}
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-9 for i in got)
    assert lexical.ranked(lexical.scores(words, ["98234"]), 3).first().id == "doc2_c001"
    assert lexical.scores(words, []).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_tiny_corpora_have_no_hits(spark, n):
    words = lexical.tokenised(spark.createDataFrame(CHUNKS[:n], "doc_id string, source string, text string"), stopwords=False)
    assert lexical.scores(words, ["rent", "the", "force"]).count() == 0


def test_dense_filter_ties_and_zero_vector(spark):
    df = spark.createDataFrame([("doc1_c001", "doc1", [0.1] * 8), ("doc1_c002", "doc1", [0.2] * 8), ("doc2_c001", "doc2", [0.85] * 8)], "id string, doc_id string, embedding array<float>")
    near = dense.nearest(df, spark.createDataFrame([([0.12] * 8,)], "embedding array<float>"), 2, id_column="id")
    assert near.count() == 2
    only = dense.nearest(df, spark.createDataFrame([([0.12] * 8,)], "embedding array<float>"), 5, id_column="id", only=dense.id_filter("doc_id", ["doc2"]))
    assert [r.id for r in only.collect()] == ["doc2_c001"]
    zero = dense.nearest(df, spark.createDataFrame([([0.0] * 8,)], "embedding array<float>"), 5, id_column="id")
    assert [(r.id, r.distance) for r in zero.orderBy("dense_rank").collect()] == [("doc1_c001", 1.0), ("doc1_c002", 1.0), ("doc2_c001", 1.0)]


@pytest.mark.parametrize("ids", [None, [], "", 0, [" ", ""]])
def test_no_filter(spark, ids):
    assert dense.id_filter("x", ids) is None


def test_filters_override(spark):
    assert dense.effective_filter([], "a") == [] and dense.effective_filter(None, "a") == "a"
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert df.where(dense.id_filter("x", 2)).count() == 1 and df.where(dense.id_filter("x", (1, "3"))).count() == 2
    assert dense.candidate_depth(4, 100) == 12 and dense.candidate_depth(1, 100) == 10 and dense.candidate_depth(4, 3) == 3


def test_fusion_order_and_gate(spark):
    near = spark.createDataFrame([("a", 0.1, 1), ("b", 0.4, 2)], "id string, distance double, dense_rank int")
    lex = spark.createDataFrame([("c", 2.0, 1), ("b", 1.0, 2)], "id string, score double, bm25_rank int")
    got = fusion.fuse(near, lex, 4).collect()
    assert [r.id for r in got] == ["b", "a", "c"] and got[0].score == 0.032258 and got[2].similarity is None
    gate = fusion.gate(spark.createDataFrame(got)).first()
    assert (gate.max_similarity, gate.any_lexical, gate.has_relevant_context) == (0.9, True, True)
    none = fusion.gate(spark.createDataFrame([], "similarity double, bm25_rank int")).first()
    assert (none.max_similarity, none.any_lexical, none.has_relevant_context) == (0.0, False, False)


def test_chunks(spark):
    pages = spark.createDataFrame([("d", 1, "x" * 79 + " tail" + "y" * 60), ("d", 2, ""), ("d", 3, "z" * 80), ("e", 1, None)], "doc_id string, page_number int, text string")
    got = chunking.chunk_pages(pages).orderBy("doc_id", "chunk_index").collect()
    assert [(r.chunk_id, r.page_number, r.char_start, r.char_end) for r in got] == [("d_c000", 1, 0, 80), ("d_c001", 1, 60, 140), ("d_c002", 1, 120, 144), ("d_c003", 3, 0, 80)]
    assert len(got[0].text) == 79 and got[0].token_count == 1 and got[1].token_count == 2
    with pytest.raises(ValueError):
        chunking.windows(pages, size=20, overlap=20)


def test_windows_against_loop(spark):
    def plain(n, size=80, overlap=20):
        at, out = 0, []
        while n:
            out.append((at, min(n, at + size)))
            if at + size >= n:
                break
            at += size - overlap
        return out

    df = spark.range(0, 400).select(F.col("id").alias("doc_id"), F.lit(1).alias("page_number"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    got = {}
    for r in chunking.chunk_pages(df).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.char_start, r.char_end))
    assert got == {n: plain(n) for n in range(1, 400)}


def test_long_texts_are_cut_in_linear_time(spark):
    """A million characters, beyond the basic plane too; a quadratic way takes more than half a minute."""
    text = "ab é\n\U0001f600 cd" * 100_000
    df = spark.createDataFrame([("d", 1, text)], "doc_id string, page_number int, text string")
    docs = df.select("doc_id", F.array(F.struct("page_number", "text")).alias("pages"))
    chunking.chunk_documents(docs.limit(0)).collect()
    began = time.perf_counter()
    got = chunking.chunk_documents(docs).select("chunk_index", "char_start", "char_end", "text").collect()
    assert time.perf_counter() - began < 6
    assert len(got) == (len(text) - 21) // 60 + 1
    for r in [*got[:50], *got[-3:]]:
        assert r.char_start == 60 * r.chunk_index and r.text == text[r.char_start : r.char_start + 80].strip() and r.char_end == min(len(text), r.char_start + 80)
    assert chunking.chunk_pages(df).count() == len(got)
    wide = chunking.windows(df, size=7, overlap=6).limit(100).collect()
    assert [r.window for r in wide] == [text[i : i + 7] for i in range(100)]


def model():
    def embed(texts):
        """Two numbers that tell texts about rent from others."""
        return [[3.0 if "rent" in t else 0.1, 0.1 if "rent" in t else 3.0] for t in texts]

    return embed


def collection(spark):
    rows = spark.createDataFrame([(i, d, t, n + 1) for n, (i, d, t) in enumerate(CHUNKS)], "chunk_id string, doc_id string, text string, page_number int")
    return retrieve.embed_chunks(rows, model())


def vector(spark, question):
    return spark.createDataFrame([(retrieve.embed_question(question, model()),)], "embedding array<double>")


def test_embeddings_have_length_one(spark):
    seen = []
    retrieve.embed_question(" query: x ", lambda texts: seen.extend(texts) or [[0.0, 0.0]])
    assert seen == ["query: x"] and retrieve.normalised([[3.0, 4.0], [0.0, 0.0]]) == [[0.6, 0.8], [0.0, 0.0]]
    for r in collection(spark).collect():
        assert abs(sum(x * x for x in r.embedding) - 1) < 1e-6


def test_retrieve(spark):
    chunks = collection(spark)
    got = retrieve.retrieve(chunks, " who pays the rent? ", vector(spark, "rent"), top_k=2)
    assert (got.question, got.total, got.depth) == ("who pays the rent?", 4, 4)
    top = got.top.collect()
    assert len(top) == 2 and top[0].chunk_id == "doc1_c001" and top[0].similarity == 1.0
    assert retrieve.has_sufficient_context(got) and retrieve.has_sufficient_context(got.top)
    only = retrieve.retrieve(chunks, "form", vector(spark, "form"), doc_ids=["contract_101"])
    assert {r.doc_id for r in only.top.collect()} == {"contract_101"} and only.total == 4
    for blank in (None, "", " \n"):
        with pytest.raises(ValueError):
            retrieve.retrieve(chunks, blank, vector(spark, "x"))
    empty = retrieve.retrieve(chunks.limit(0), "rent", vector(spark, "rent"))
    assert empty.total == 0 and empty.top.count() == 0 and not retrieve.has_sufficient_context(empty)
    assert [r.type for r in retrieve.answer_stream(empty).collect()].count("sources") == 1


def test_answer_stream(spark):
    chunks = collection(spark)
    rows = retrieve.answer_stream(retrieve.retrieve(chunks, "rent", vector(spark, "rent"), top_k=2)).orderBy("position").collect()
    assert [r.type for r in rows] == ["token"] * (len(rows) - 1) + ["sources"]
    assert "".join(r.content for r in rows).strip() == "بر اساس اسناد ارائه‌شده (صفحه 1):\n" + CHUNKS[0][2]
    assert [c.doc_id for c in rows[-1].citations][0] == "contract_101" and len(rows[-1].citations) == 2
    none = retrieve.answer_stream(retrieve.retrieve(chunks, "qqxzqq", vector(spark, "rent"), least=1.1)).orderBy("position").collect()
    assert "".join(r.content for r in none) == prompt.FALLBACK + " " and none[-1].type == "sources" and none[-1].citations == []


def test_chunks_of_page_arrays(spark):
    rows = [("d", [(1, "x" * 150), (2, ""), (3, None), (4, "z" * 80)]), ("e", []), ("f", [(9, "one two")])]
    docs = spark.createDataFrame(rows, "doc_id string, pages array<struct<page_number: int, text: string>>")
    pages = docs.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")
    key = lambda r: (r.doc_id, r.chunk_index)
    assert sorted(chunking.chunk_documents(docs).collect(), key=key) == sorted(chunking.chunk_pages(pages).collect(), key=key)
    assert "Exchange" not in chunking.chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()


def test_nearest_of_each_query(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300, [0.0] * 4), (301, None), (302, [1.0]), (303, [1.0, None, 2.0, 3.0]), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    some = df.where("vec_id % 3 = 0 or vec_id > 299")

    def unit(v):
        v = np.array(v if v is not None and None not in v else [], float)
        return v / np.linalg.norm(v) if v.any() else None

    def far(a, b):
        a, b = unit(a), unit(b)
        return 1.0 if a is None or b is None or len(a) != len(b) else round(1 - float(a @ b), 9)

    held = [r for r in rows if r[0] is not None]
    asked = [r for r in held if r[0] % 3 == 0 or r[0] > 299]
    want = {q: [i for _, i in sorted((far(v, x), i) for i, x in held)[:5]] for q, v in asked}
    for block in (512, 7):  # queries in one block or in several
        got = {}
        for r in dense.nearest_each(df, some, 5, block_rows=block).orderBy("query_id", "dense_rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
    assert dense.nearest_each(df, some.limit(0), 5).count() == 0 and dense.nearest_each(df.limit(0), some, 5).count() == 0


def test_awaited_records(spark):
    async def told(found):
        return [r async for r in retrieve.answer_records(found, pause=0)]

    found = retrieve.retrieve(collection(spark), "rent", vector(spark, "rent"), top_k=2)
    records = asyncio.run(told(found))
    assert [r["type"] for r in records] == ["token"] * (len(records) - 1) + ["sources"]
    assert "".join(r["content"] for r in records).strip() == "بر اساس اسناد ارائه‌شده (صفحه 1):\n" + CHUNKS[0][2]
    assert [c["doc_id"] for c in records[-1]["citations"]][0] == "contract_101"


def test_synthetic_questions(spark):
    chunks = spark.createDataFrame([("a", f"a_c{i:03d}") for i in range(9)] + [("b", "b_c000")], "doc_id string, chunk_id string")
    once, again = (sorted(map(tuple, synthetic.build_questions(chunks).collect())) for _ in range(2))
    assert once == again and [(r[0], len(r[5])) for r in once] == [("a_qa001", 2), ("a_qa002", 2), ("a_qa003", 2), ("b_qa001", 1), ("b_qa002", 1), ("b_qa003", 1)]
    assert len({tuple(r[5]) for r in once[:3]}) > 1 and synthetic.build_questions(chunks.limit(0)).count() == 0
    assert synthetic.build_questions(chunks).schema.simpleString().replace("struct<", "").replace(":", " ").startswith("qa_id string,doc_id string,question string")
