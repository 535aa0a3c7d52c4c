import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexispark import folders
from lexispark.operators import inverted, lexical, prompt, retrieve


def corpus(spark, n=400):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, rng.choices(vocabulary, weights, k=rng.choice([0, 3, 8, 30, 200]))) for i in range(n)]
    rows += [(n + i, ["w40", "w41", "w41"]) for i in range(150)] + [(n + 900, ["alone"]), (n + 901, ["w0"] * 5000)]
    return rows, spark.createDataFrame(rows, "id long, words array<string>").repartition(3)


QUESTIONS = [(1, ["w3", "w40", "w41"]), (2, ["w0"]), (3, ["alone", "absent"]), (4, ["w7", "w7", "w50", "w12"]), (5, []), (6, ["absent"]), (7, [f"w{i}" for i in range(60)]), (8, ["alone", "w59", "w58"])]


@pytest.mark.parametrize(("range_docs", "first"), [(16, 1), (64, 2), (10_000, 2)])
def test_equals_a_search_through_all_texts(spark, range_docs, first):
    rows, words = corpus(spark)
    index = inverted.build_postings(words, folders.new_folder(spark, "postings"), range_docs=range_docs, buckets=4)
    again = inverted.Postings.open(spark, index.path)
    assert again == index and index.texts == len(rows)
    asked = spark.createDataFrame(QUESTIONS, "query_id long, words array<string>")
    got = {}
    for r in inverted.search(again, asked, 10, first=first).orderBy("query_id", "bm25_rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
        assert len(got[r.query_id]) == r.bm25_rank
    statistics = lexical.term_statistics(words).cache()
    for q, terms in QUESTIONS:
        scored = lexical.scores(words, terms, statistics).select("id", F.round("score", 9).alias("score"))
        assert got.get(q, []) == [(r.id, r.score) for r in scored.orderBy(F.desc("score"), "id").limit(10).collect()]


def test_blocks_that_cannot_win_are_skipped(spark):
    rows, words = corpus(spark)
    index = inverted.build_postings(words, folders.new_folder(spark, "postings"), range_docs=8)
    terms = inverted.question_terms(index, spark.createDataFrame([(1, ["w3", "w59", "alone"])], "query_id long, words array<string>"))
    _, rest = inverted.reached(index, terms, 1, first=3)
    every = inverted.bounds(index, terms).count()
    assert every > 40 and rest.count() < every / 2
    blocks = index.blocks(spark)
    assert blocks.select(F.max(F.size("postings"))).first()[0] <= 40
    n = Counter(w for _, ws in rows for w in set(ws))
    assert {r.term: r.n for r in blocks.groupBy("term").agg(F.sum(F.size("postings")).alias("n")).collect()} == n
    plan = inverted.bounds(index, terms)._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan.split("ReadSchema", 1)[1].split(">")[0]


def test_empty_corpus_and_no_questions(spark):
    none = spark.createDataFrame([], "id long, words array<string>")
    index = inverted.build_postings(none, folders.new_folder(spark, "postings"))
    asked = spark.createDataFrame(QUESTIONS, "query_id long, words array<string>")
    assert inverted.search(index, asked, 3).count() == 0
    _, words = corpus(spark, 20)
    index = inverted.build_postings(words, folders.new_folder(spark, "postings"))
    assert inverted.search(index, asked.limit(0), 3).count() == 0


@pytest.mark.parametrize("indexed", [False, True])
def test_many_questions_equal_one_at_a_time(spark, indexed):
    rng = random.Random(4)
    rows = [(f"c{i:03d}", f"d{i % 3}", " ".join(rng.choices(["rent", "force", "owner", "form", "x1", "break"], [1, 1, 1, 1, 3, 1], k=rng.randrange(0, 12))), i, [rng.random(), rng.random(), rng.random()]) for i in range(80)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, page_number int, embedding array<double>")
    listed = [("a", " who pays the rent? ", [0.1, 0.9, 0.2]), ("b", "force form form", [0.9, 0.1, 0.1]), ("c", "qqxzqq", [0.0, 0.0, 0.0]), ("d", "  ", [1.0, 0.0, 0.0]), ("e", "owner", [0.3, 0.3, 0.3])]
    questions = spark.createDataFrame(listed, "query_id string, question string, embedding array<double>")
    held = retrieve.Collection.build(chunks, folders.new_folder(spark, "collection"), indexed=indexed)
    got = retrieve.retrieve_each(held, questions, top_k=3, probes=10**6)
    gates = {r.query_id: r for r in got.gate.collect()}
    assert gates.keys() == {"a", "b", "c", "e"} and {r.query_id for r in got.questions.collect()} == gates.keys()
    tops = got.top.orderBy("query_id", "place").collect()
    for name, question, vector in listed:
        if not question.strip():
            continue
        one = retrieve.retrieve(chunks, question, spark.createDataFrame([(vector,)], "embedding array<double>"), top_k=3)
        alone = one.top.orderBy(*retrieve.best_first()).collect()
        mine = [r for r in tops if r.query_id == name]
        assert got.depth == one.depth and [(r.place, r.chunk_id, r.score, r.similarity, r.dense_rank, r.bm25_rank) for r in mine] == [(i + 1, r.chunk_id, r.score, r.similarity, r.dense_rank, r.bm25_rank) for i, r in enumerate(alone)]
        gate = one.gate.first()
        assert (gates[name].max_similarity, gates[name].any_lexical, gates[name].has_relevant_context) == tuple(gate)
    empty = retrieve.Collection.build(chunks.limit(0), folders.new_folder(spark, "collection"))
    none = retrieve.retrieve_each(empty, questions)
    assert none.top.count() == 0 and not any(r.has_relevant_context for r in none.gate.collect())


def test_answers_of_a_model(spark):
    """Tokens that came before a failure stay, a batch that fails is asked again one by one, and nobody asks about closed questions."""
    rows = [(f"c{i}", "d", f"rent {i} owner", i, [1.0, float(i)]) for i in range(12)] + [(f"z{i}", "d", "x", i, [1.0, 5.0]) for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, page_number int, embedding array<double>")
    listed = [(i, q, [1.0, 0.0]) for i, q in enumerate(["rent", "owner breaks late", "owner breaks at once", "owner empty", "rent again"])] + [(9, "qqxzqq", [0.0, 0.0])]
    held = retrieve.Collection.build(chunks, folders.new_folder(spark, "collection"))
    found = retrieve.retrieve_each(held, spark.createDataFrame(listed, "query_id long, question string, embedding array<double>"), top_k=2)

    def load():
        def answer(prompts):
            assert not any("qqxzqq" in p for p in prompts)
            if any("at once" in p for p in prompts):
                raise OSError("no model")

            def one(p):
                if "empty" not in p:
                    yield from ["so ", "", "many"]
                if "late" in p:
                    raise ValueError("cut off")

            return [one(p) for p in prompts]

        return answer

    said = {}
    for r in retrieve.answer_each(found, load).orderBy("query_id", "position").collect():
        said.setdefault(r.query_id, []).append((r.type, r.content, len(r.citations)))
    error = prompt.ERROR.partition("{")[0]
    ok = [("token", "so ", 0), ("token", "many", 0), ("sources", "", 2)]
    assert said[0] == said[4] == ok
    assert said[1] == [*ok[:2], ("token", f"{error}cut off", 0), ok[2]] and said[2] == [("token", f"{error}no model", 0), ok[2]] and said[3] == [ok[2]]
    assert [x[1] for x in said[9]] == [f"{w} " for w in prompt.FALLBACK.split(" ")] + [""] and said[9][-1] == ("sources", "", 0)
    plain = retrieve.answer_each(found).where("query_id = 0").orderBy("position").collect()
    assert "".join(r.content for r in plain).startswith("بر اساس") and [r.position for r in plain] == list(range(len(plain)))


@pytest.mark.parametrize("sizes", [{}, {"segment_words": 900, "block_terms": 12, "block_questions": 3}])
def test_streamed_texts_equal_the_postings(spark, sizes):
    """Also with terms that many questions have, scored apart, and with blocks and segments of a few rows."""
    rows, words = corpus(spark)
    words = words.unionByName(spark.createDataFrame([(5000, None), (5001, [])], "id long, words array<string>"))
    index = inverted.build_postings(words, folders.new_folder(spark, "postings"))
    asked = spark.createDataFrame(QUESTIONS + [(20 + i, rows[i][1]) for i in range(0, 60, 3)], "query_id long, words array<string>")
    plain = sorted(map(tuple, inverted.search(index, asked, 10).select("query_id", "bm25_rank", "id", "score").collect()))
    streamed = sorted(map(tuple, inverted.search_streamed(index, words, asked, 10, **sizes).select("query_id", "bm25_rank", "id", "score").collect()))
    assert len(plain) > 150 and streamed == plain
    assert inverted.search_streamed(index, words, asked.limit(0), 10).count() == 0


def test_long_questions_shuffle_no_pairs(spark):
    """Whole texts as questions: what leaves a task are the best rows of each, not a row for each pair with a common term."""
    _, words = corpus(spark)
    index = inverted.build_postings(words, folders.new_folder(spark, "postings"))
    asked = words.where("id % 5 = 0").select(F.col("id").alias("query_id"), "words")
    found = inverted.search_each(index, words, asked, 10, most_terms=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "postings:array" not in plan
    assert inverted.search_each(index, words, asked.limit(1), 10, most_terms=10**6)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 0


def test_few_terms_meet_blocks_where_these_lie(spark):
    """Blocks hold documents that lie together, as no words are dealt to build them; a search doesn't shuffle them to its terms either."""
    rows = [(i, ["w0", f"w{i % 7}"]) for i in range(100)]
    index = inverted.build_postings(spark.createDataFrame(rows, "id long, words array<string>").coalesce(1), folders.new_folder(spark, "postings"), range_docs=10)
    held = index.blocks(spark).where("term = 'w0'").select(F.transform("postings", lambda p: p["id"]).alias("ids")).collect()
    assert index.words == 200 and sorted(r.ids for r in held) == [list(range(i, i + 10)) for i in range(0, 100, 10)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = inverted.search(index, spark.createDataFrame([(1, ["w3", "w5"])], "query_id long, words array<string>"), 10)
        plan = inverted.bounds(index, inverted._few(inverted.question_terms(index, spark.createDataFrame([(1, ["w3"])], "query_id long, words array<string>")), 10))._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 10 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
