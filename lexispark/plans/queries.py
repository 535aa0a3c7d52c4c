"""Queries over the driver's tables, each with its SQL for DuckDB where SQL can say it.

``documents`` stands for pages (one a document), ``embeddings`` for chunk vectors (vec_id is a doc_id),
``conversations`` for chats (conv_id) with messages (turn), ``lang`` for a collection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import folders, schemas
from ..functions import text as T
from ..operators import chunking, corpus as stored_corpus, dense, fusion, inverted, layout, lexical, prompt, retrieve, store, vector_index
from ..sources import readers, synthetic
from ..streaming import guard, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERY = ["the", "tion", "que", "the"]
TOKENS = r"regexp_extract_all(lower(regexp_replace(translate(coalesce(text, ''), 'يك', 'یک'), '[\x{064B}-\x{0652}]', '', 'g')), '[\p{L}\p{N}_\x{0600}-\x{06FF}]+')"
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


found: dict[str, Query] = {}
sql: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f: Query) -> Query:
        found[name] = f
        if oracle:
            sql[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, rows: DataFrame, label: str, *keys: str) -> store.Table:
    """A table of its own in the shared folder, with ``rows`` in it."""
    own = store.Table(spark, folders.new_folder(spark, label), rows.schema, keys)
    own.replace(rows)
    return own


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.tokenised(table(spark, sf_dir, "documents"))


def question_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 7")


@query("tokens", f"SELECT doc_id, CAST(len(w) AS INT) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS} AS w FROM documents)")
def tokens(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


ENGLISH = ["the", "of", "and", "to", "in", "a", "is"]


@query("tokens_without_stopwords", f"SELECT doc_id, CAST(len(k) AS INT) AS n_tokens, md5(array_to_string(k, ' ')) AS tokens_md5 FROM (SELECT doc_id, CASE WHEN len(f) = 0 THEN w ELSE f END AS k FROM (SELECT doc_id, w, list_filter(w, lambda x: NOT list_contains({ENGLISH}, x)) AS f FROM (SELECT doc_id, {TOKENS} AS w FROM documents)))")
def tokens_without_stopwords(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", T.without_stopwords(T.tokens(F.col("text")), ENGLISH).alias("w"))
    return words.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


BM25 = f"""
w AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS average FROM w),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(w) AS term FROM w) GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 5E-1) - ln(df + 5E-1) AS raw FROM df, s),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 25E-2 * avg(raw) OVER () ELSE raw END AS idf FROM raw)"""
SCORES = """,
q AS (SELECT term, count(*) AS times FROM (SELECT unnest(['the', 'tion', 'que', 'the']) AS term) GROUP BY term),
tf AS (SELECT id, len(w) AS dl, term, times, len(list_filter(w, lambda x: x = term)) AS tf FROM w, q),
score AS (SELECT id, sum(times * idf * tf * 25E-1 / (tf + 15E-1 * (1 - 75E-2 + 75E-2 * dl / average))) AS score FROM tf JOIN idf USING (term), s WHERE tf > 0 GROUP BY id)"""
LEXICAL = """,
lex AS (SELECT id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS bm25_rank FROM score WHERE score > 0 ORDER BY bm25_rank LIMIT {k})"""
DENSE = """
dense AS (SELECT v.vec_id AS id, 1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance,
  CAST(row_number() OVER (ORDER BY 1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), v.vec_id) AS INT) AS dense_rank
  FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q {where} ORDER BY dense_rank LIMIT {k})"""
FUSED = """,
fused AS (SELECT id, CASE WHEN distance IS NOT NULL THEN round(greatest(0E0, 1 - distance), 4) END AS similarity, dense_rank, bm25_rank, round(coalesce(1E0 / (60 + dense_rank), 0) + coalesce(1E0 / (60 + bm25_rank), 0), 6) AS score
  FROM dense FULL JOIN lex USING (id) ORDER BY 5 DESC, dense_rank ASC NULLS LAST, bm25_rank LIMIT 4)"""


@query("bm25_statistics", f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_statistics(spark, sf_dir):
    return lexical.term_statistics(corpus(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


EDITED = """edited AS (SELECT doc_id, lang, CASE WHEN doc_id % 10 = 0 THEN coalesce(text, '') || ' ' || source ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3 AND lang = 'en')"""


@query("bm25_statistics_kept", f"WITH {EDITED}, {BM25.replace('FROM documents', 'FROM edited')} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_statistics_kept(spark, sf_dir):
    """A stored corpus of which a tenth is rewritten and a tenth deleted: its kept counts are those of the texts that are left."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("lang").alias("collection"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("doc_id"), "text", F.lit(0).cast("long").alias("seq"))
    held = stored_corpus.Corpus(spark, folders.new_folder(spark, "corpus"))
    held.upsert(rows)
    edited = docs.where("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat_ws(" ", F.coalesce("text", F.lit("")), "source").alias("edited"))
    held.upsert(rows.join(edited, "chunk_id").withColumn("text", F.col("edited")).withColumn("seq", F.lit(1).cast("long")))
    held.delete(F.col("chunk_id").cast("long") % 10 == 3)
    return held.statistics("en").select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"WITH {BM25}{SCORES}{LEXICAL.format(k=12)} SELECT * FROM lex")
def bm25_topk(spark, sf_dir):
    return lexical.ranked(lexical.scores(corpus(spark, sf_dir), QUERY), 12).select("id", F.round("score", 6).alias("score"), "bm25_rank")


@query("bm25_topk_filtered", f"WITH {BM25.replace('FROM documents', "FROM documents WHERE lang IN ('fr', 'es')")}{SCORES}{LEXICAL.format(k=12)} SELECT * FROM lex")
def bm25_topk_filtered(spark, sf_dir):
    """Statistics are those of the filtered corpus."""
    some = table(spark, sf_dir, "documents").where(dense.id_filter("lang", ["fr", "es", " "]))
    return lexical.ranked(lexical.scores(lexical.tokenised(some), QUERY), 12).select("id", F.round("score", 6).alias("score"), "bm25_rank")


@query("dense_topk", f"WITH {DENSE.format(where='', k=12)} SELECT id, round(greatest(0E0, 1 - distance), 4) AS similarity, dense_rank FROM dense")
def dense_topk(spark, sf_dir):
    top = dense.nearest(table(spark, sf_dir, "embeddings"), question_vector(spark, sf_dir), 12)
    return top.select("id", dense.similarity(F.col("distance")).alias("similarity"), "dense_rank")


@query("dense_topk_filtered", f"WITH {DENSE.format(where="WHERE CAST(v.label AS VARCHAR) IN ('1', '3')", k=12)} SELECT id, round(greatest(0E0, 1 - distance), 4) AS similarity, dense_rank FROM dense")
def dense_topk_filtered(spark, sf_dir):
    top = dense.nearest(table(spark, sf_dir, "embeddings"), question_vector(spark, sf_dir), 12, only=dense.id_filter("label", [1, "3", ""]))
    return top.select("id", dense.similarity(F.col("distance")).alias("similarity"), "dense_rank")


@query("dense_topk_each", """SELECT q.vec_id AS query_id, v.vec_id AS id, round(greatest(0E0, 1 - round(1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9)), 4) AS similarity,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9), v.vec_id) AS INT) AS dense_rank
  FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY dense_rank <= 12""")
def dense_topk_each(spark, sf_dir):
    """Every row whose id is divisible by 100 asks; all rows are searched."""
    vectors = table(spark, sf_dir, "embeddings")
    top = dense.nearest_each(vectors, vectors.where("vec_id % 100 = 0"), 12)
    return top.select("query_id", "id", dense.similarity(F.col("distance")).alias("similarity"), "dense_rank")


@query("bm25_postings_topk", sql["bm25_topk"].replace("round(score, 6) AS score, CAST", "round(score, 6) AS score, CAST"))
def bm25_postings_topk(spark, sf_dir):
    """The same question answered from stored postings; no text is read once they are there."""
    held = inverted.build_postings(corpus(spark, sf_dir), folders.new_folder(spark, "postings"))
    asked = spark.createDataFrame([(0, QUERY)], "query_id int, words array<string>")
    return inverted.search(held, asked, 12).select("id", F.round("score", 6).alias("score"), "bm25_rank")


def _index(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vector_index.build_index(vectors, folders.new_folder(spark, "vectors"))


@query("vector_index_exact", sql["dense_topk_each"])
def vector_index_exact(spark, sf_dir):
    """The index with all its cells probed is the exact search: every row lies in it."""
    vectors, index = _index(spark, sf_dir)
    top = vector_index.search_index(index, vectors.where("vec_id % 100 = 0"), 12, probes=vector_index.MOST_CELLS)
    return top.select("query_id", "id", dense.similarity(F.col("distance")).alias("similarity"), "dense_rank")


@query("vector_index_search")
def vector_index_search(spark, sf_dir):
    """Every row whose id is divisible by 100 asks the index, with as many probes as reach 0.95 on other queries; ``recall`` is measured against the exact search."""
    vectors, index = _index(spark, sf_dir)
    queries = vectors.where("vec_id % 100 = 0")
    top = vector_index.search_index(index, queries, 12, probes=vector_index.probes_for(index, vectors, 12, 0.95))
    measured = vector_index.recall(top, dense.nearest_each(vectors, queries, 12))
    return top.select("query_id", "id", dense.similarity(F.col("distance")).alias("similarity"), "dense_rank").crossJoin(F.broadcast(measured.select(F.round("recall", 4).alias("recall"))))


def _fused(spark, sf_dir):
    near = dense.nearest(table(spark, sf_dir, "embeddings"), question_vector(spark, sf_dir), 12)
    return fusion.fuse(near, lexical.ranked(lexical.scores(corpus(spark, sf_dir), QUERY), 12), 4)


HYBRID = f"WITH {BM25}{SCORES}{LEXICAL.format(k=12)},{DENSE.format(where='', k=12)}{FUSED}"


@query("hybrid_rrf", f"{HYBRID} SELECT * FROM fused")
def hybrid_rrf(spark, sf_dir):
    return _fused(spark, sf_dir)


@query("relevance_gate", f"{HYBRID} SELECT coalesce(max(similarity), 0E0) AS max_similarity, coalesce(bool_or(bm25_rank IS NOT NULL), false) AS any_lexical, coalesce(max(similarity), 0E0) >= 8E-1 OR coalesce(bool_or(bm25_rank IS NOT NULL), false) AS has_relevant_context FROM fused")
def relevance_gate(spark, sf_dir):
    return fusion.gate(_fused(spark, sf_dir))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_WITH_HEAD, _WITH_MIDDLE, _WITH_TAIL = (prompt.WITH_CONTEXT.partition("{context}")[0], *prompt.WITH_CONTEXT.partition("{context}")[2].partition("{question}")[::2])
_SQL_PROMPT = f"'<|im_start|>system' || chr(10) || {_quoted(prompt.SYSTEM.strip())} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {strip_sql(f"{_quoted(_WITH_HEAD)} || context || {_quoted(_WITH_MIDDLE)} || {strip_sql('text')} || {_quoted(_WITH_TAIL)}")} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
#: Every row whose id is divisible by 100 asks, with its own text and vector.
EACH = f"""WITH {BM25.replace('FROM documents', 'FROM documents JOIN embeddings ON doc_id = vec_id')},
post AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY id, term),
q AS (SELECT id AS query_id, term, tf AS times FROM post WHERE id % 100 = 0),
score AS (SELECT query_id, p.id, round(sum(times * idf * tf * 25E-1 / (tf + 15E-1 * (1 - 75E-2 + 75E-2 * dl / average))), 9) AS score FROM q JOIN post p USING (term) JOIN idf USING (term), s GROUP BY 1, 2),
lex AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS bm25_rank FROM score WHERE score > 0 QUALIFY bm25_rank <= 15),
near AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS distance FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND q.vec_id IN (SELECT id FROM w) AND v.vec_id IN (SELECT id FROM w)),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS dense_rank FROM near QUALIFY dense_rank <= 15),
fused AS (SELECT query_id, id, CASE WHEN distance IS NOT NULL THEN round(greatest(0E0, 1 - distance), 4) END AS similarity, dense_rank, bm25_rank, round(coalesce(1E0 / (60 + dense_rank), 0) + coalesce(1E0 / (60 + bm25_rank), 0), 6) AS score
  FROM dense FULL JOIN lex USING (query_id, id)),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank ASC NULLS LAST, bm25_rank) AS INT) AS place FROM fused QUALIFY place <= 5)"""


def _retrieved_each(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("doc_id"), "text", F.lit(1).alias("page_number"))
    chunks = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")
    held = retrieve.Collection.build(chunks, folders.new_folder(spark, "collection"))
    asked = held.chunks.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("question"))
    questions = asked.join(held.vectors.select(F.col("id").alias("query_id"), "embedding"), "query_id")
    return retrieve.retrieve_each(held, questions, top_k=5)


@query("retrieve_each", f"{EACH} SELECT query_id, place, id AS chunk_id, lang AS doc_id, md5(text) AS text_md5, similarity, dense_rank, bm25_rank, score FROM top JOIN documents ON id = doc_id")
def retrieve_each(spark, sf_dir):
    """A whole retrieval for every row whose id is divisible by 100, in one job."""
    return _retrieved_each(spark, sf_dir).top.select("query_id", "place", "chunk_id", "doc_id", F.md5("text").alias("text_md5"), "similarity", "dense_rank", "bm25_rank", "score")


SAID = f"""{EACH}, gate AS (SELECT query_id, coalesce(max(similarity), 0E0) >= 8E-1 OR coalesce(bool_or(bm25_rank IS NOT NULL), false) AS open FROM top GROUP BY query_id),
placed AS (SELECT t.*, d.text, d.lang FROM top t JOIN documents d ON t.id = d.doc_id),
cited AS (SELECT query_id, string_agg(lang || ':1:' || printf('%.3f', round(coalesce(similarity, score), 3)), ',' ORDER BY place) AS cited FROM placed GROUP BY query_id),
said AS (SELECT query_id, CASE WHEN open THEN 'بر اساس اسناد ارائه‌شده (صفحه 1):' || chr(10) || {strip_sql('text')} ELSE '{prompt.FALLBACK}' END AS answer, CASE WHEN open THEN cited ELSE '' END AS cited FROM gate JOIN placed USING (query_id) JOIN cited USING (query_id) WHERE place = 1)"""


@query("answer_each", f"{SAID} SELECT query_id, CAST(len(string_split(answer, ' ')) AS BIGINT) AS n_tokens, md5(answer || ' ') AS answer_md5, cited FROM said")
def answer_each(spark, sf_dir):
    """The answers of all questions, token by token, with their sources."""
    told = retrieve.answer_each(_retrieved_each(spark, sf_dir))
    return _answers(told)


def _answers(told):
    token = F.col("type") == "token"
    ordered = F.array_sort(F.collect_list(F.when(token, F.struct("position", "content"))))
    cited = F.transform("citations", lambda c: F.concat_ws(":", c["doc_id"], c["page_number"].cast("string"), F.format_number(c["score"], 3)))
    return told.groupBy("query_id").agg(F.count(F.when(token, 1)).alias("n_tokens"), F.md5(F.array_join(F.transform(ordered, lambda x: x["content"]), "")).alias("answer_md5"), F.max(F.when(~token, F.array_join(cited, ","))).alias("cited"))


def _stand_in():
    """A model that gives the number of characters it was asked with, and breaks off where the prompt holds its word."""

    def answer(prompts):
        def one(p):
            yield "n "
            if "the the" in p.lower():
                raise RuntimeError("too many")
            yield str(len(p))

        return [one(p) for p in prompts]

    return answer


_ERROR = prompt.ERROR.format(error="too many")


@query("answer_with_model", f"""{SAID.replace("said AS (", "unused AS (")},
blocks AS (SELECT query_id, string_agg('[منبع شماره ' || place || ' | سند: ' || lang || ' | شماره صفحه: 1]' || chr(10) || {strip_sql('text')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context FROM placed GROUP BY query_id),
asked AS (SELECT query_id, {_SQL_PROMPT} AS prompt FROM blocks JOIN documents d ON query_id = d.doc_id)
SELECT query_id, CASE WHEN contains(lower(prompt), 'the the') THEN 'n |{_ERROR}' ELSE 'n |' || length(prompt) END AS told FROM asked""")
def answer_with_model(spark, sf_dir):
    """Answers of a model that a task holds; a question on which it breaks off ends with the error, the others of its batch have their answers."""
    told = retrieve.answer_each(_retrieved_each(spark, sf_dir), _stand_in, batch=4).where("type = 'token'")
    return told.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: x["content"]), "|").alias("told"))


@query("relevance_gate_each", f"{EACH} SELECT query_id, coalesce(max(similarity), 0E0) AS max_similarity, coalesce(bool_or(bm25_rank IS NOT NULL), false) AS any_lexical, coalesce(max(similarity), 0E0) >= 8E-1 OR coalesce(bool_or(bm25_rank IS NOT NULL), false) AS has_relevant_context FROM top GROUP BY query_id")
def relevance_gate_each(spark, sf_dir):
    return _retrieved_each(spark, sf_dir).gate


QUESTION = " the tion que the "
#: Chunks are documents that have a vector; ``lang`` stands for the document that a chunk is of.
OF_CHUNKS = "FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang IN ('en', 'es')"
RETRIEVED = f"WITH {BM25.replace('FROM documents', OF_CHUNKS)}{SCORES}{LEXICAL.format(k=15)},{DENSE.format(where="WHERE v.vec_id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'es'))", k=15)}{FUSED.replace('LIMIT 4', 'LIMIT 5')}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, dense_rank ASC NULLS LAST, bm25_rank) AS place FROM fused JOIN documents ON id = doc_id)"


def _retrieved(spark, sf_dir, question=QUESTION, least=0.8):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("doc_id"), "text", F.lit(1).alias("page_number"))
    chunks = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")
    return retrieve.retrieve(chunks, question, question_vector(spark, sf_dir), top_k=5, doc_ids=["en", "es", " "], least=least)


@query("retrieve", f"{RETRIEVED} SELECT id AS chunk_id, lang AS doc_id, md5(text) AS text_md5, similarity, dense_rank, bm25_rank, score FROM top")
def retrieve_chunks(spark, sf_dir):
    """A whole retrieval over a filtered collection, with depth by the collection's size."""
    return _retrieved(spark, sf_dir).top.select("chunk_id", "doc_id", F.md5("text").alias("text_md5"), "similarity", "dense_rank", "bm25_rank", "score")


@query("answer_stream", f"""{RETRIEVED}, gate AS (SELECT coalesce(max(similarity), 0E0) >= 8E-1 OR coalesce(bool_or(bm25_rank IS NOT NULL), false) AS open FROM fused),
said AS (SELECT CASE WHEN open THEN (SELECT 'بر اساس اسناد ارائه‌شده (صفحه 1):' || chr(10) || {strip_sql('text')} FROM top WHERE place = 1) ELSE {"'" + prompt.FALLBACK + "'"} END AS answer, open FROM gate),
t AS (SELECT unnest(string_split(answer, ' ')) AS piece, generate_subscripts(string_split(answer, ' '), 1) AS i FROM said)
SELECT CAST(i - 1 AS INT) AS position, 'token' AS type, piece || ' ' AS content, '' AS cited FROM t
UNION ALL SELECT CAST((SELECT max(i) FROM t) AS INT), 'sources', '', CASE WHEN open THEN (SELECT string_agg(lang || ':1:' || printf('%.3f', round(coalesce(similarity, score), 3)), ',' ORDER BY place) FROM top) ELSE '' END FROM said""")
def answer_stream(spark, sf_dir):
    return _told(retrieve.answer_stream(_retrieved(spark, sf_dir)))


@query("answer_stream_fast_exit", f"SELECT CAST(i - 1 AS INT) AS position, 'token' AS type, piece || ' ' AS content, '' AS cited FROM (SELECT unnest(string_split({"'" + prompt.FALLBACK + "'"}, ' ')) AS piece, generate_subscripts(string_split({"'" + prompt.FALLBACK + "'"}, ' '), 1) AS i) UNION ALL SELECT {len(prompt.FALLBACK.split(' '))}, 'sources', '', ''")
def answer_stream_fast_exit(spark, sf_dir):
    """No word of the question occurs, and no vector is near enough: the fixed sentence, and empty sources."""
    return _told(retrieve.answer_stream(_retrieved(spark, sf_dir, question="qqxzqq", least=1.5)))


def _told(records):
    cited = F.transform("citations", lambda c: F.concat_ws(":", c["doc_id"], c["page_number"].cast("string"), F.format_number(c["score"], 3)))
    return records.select("position", "type", "content", F.array_join(cited, ",").alias("cited"))


CHUNKS = f"""chunks AS (
  SELECT doc_id || '_c' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS chunk_id, doc_id, CAST(i AS INT) AS chunk_index, {strip_sql('w')} AS text, 1 AS page_number,
    CAST(s AS INT) AS char_start, CAST(least(s + 80, n) AS INT) AS char_end, CAST(len(list_filter(regexp_split_to_array(w, '{SPACE}+'), lambda x: x <> '')) AS INT) AS token_count
  FROM (SELECT doc_id, s, n, s // 60 AS i, substring(text, s + 1, 80) AS w FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(0, length(text) - 21) + 1, 60)) AS s FROM documents WHERE length(text) > 0)))"""


def _chunks(spark, sf_dir):
    page = F.struct(F.lit(1).alias("page_number"), "text")
    return chunking.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", F.array(page).alias("pages")))


@query("chunk_documents", f"WITH {CHUNKS} SELECT * FROM chunks")
def chunk_documents(spark, sf_dir):
    return _chunks(spark, sf_dir)


@query("chunk_statistics", f"WITH {CHUNKS} SELECT doc_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, max(char_end) AS longest FROM chunks GROUP BY doc_id")
def chunk_statistics(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.max("char_end").alias("longest"))


@query("chunk_vectors", f"WITH {CHUNKS} SELECT chunk_id, vec_id, label FROM chunks JOIN embeddings ON doc_id = vec_id")
def chunk_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return _chunks(spark, sf_dir).join(vectors, F.col("doc_id") == F.col("vec_id")).select("chunk_id", "vec_id", "label")


_ASKED = synthetic.QUESTION.replace("%s", "{}", 1).replace("%d", "{}").replace("%s", "{}")
_KINDS = "[" + ", ".join(f"'{kind}'" for kind in synthetic.KINDS) + "]"


@query("synthetic_questions", f"""WITH {CHUNKS}, few AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, chunk_id, i, row_number() OVER (PARTITION BY doc_id, i ORDER BY md5('42:' || i || ':' || chunk_id), chunk_id) AS drawn FROM chunks, range(1, 4) t(i) QUALIFY drawn <= 2)
SELECT doc_id || '_qa' || lpad(CAST(i AS VARCHAR), 3, '0') AS qa_id, doc_id, format('{_ASKED}', {_KINDS}[i], i, doc_id) AS question, {_KINDS}[i] AS question_type, string_agg(chunk_id, ',' ORDER BY drawn) AS supporting FROM few GROUP BY doc_id, i""")
def synthetic_questions(spark, sf_dir):
    asked = synthetic.build_questions(_chunks(spark, sf_dir))
    return asked.select("qa_id", "doc_id", "question", "question_type", F.array_join("supporting_chunk_ids", ",").alias("supporting"))


@query("document_ids", "SELECT doc_id, 'doc_' || substring(sha256(source || '_' || CAST(n_chars AS VARCHAR)), 1, 8) AS file_id FROM documents")
def document_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.document_id(F.col("source"), F.col("n_chars")).alias("file_id"))


@query("embedding_prefix", "SELECT doc_id, md5(CASE WHEN starts_with(text, 'passage: ') THEN text ELSE 'passage: ' || text END) AS passage_md5 FROM documents")
def embedding_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.with_prefix(F.col("text"), "passage")).alias("passage_md5"))


@query("citations", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(doc_id AS VARCHAR) AS filename, 1 AS page_number, round(coalesce(CASE WHEN doc_id % 2 = 0 THEN n_chars / 1E4 END, 16E-3), 3) AS score, {strip_sql("CASE WHEN length(text) > 140 THEN substring(text, 1, 140) || '...' ELSE text END")} AS snippet FROM documents")
def citations(spark, sf_dir):
    """Every second document has a similarity; the others fall back on their fused score."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("page_number"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") / 10000).alias("similarity"), F.lit(0.016).alias("score"))
    return docs.select(*prompt.citation_columns())


def _context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("g", F.expr("doc_id div 4"))
    chunk = F.struct("doc_id", "text", F.when(F.col("doc_id") % 4 == 1, 0).otherwise(F.col("doc_id") % 7).alias("page_number"))
    grouped = docs.groupBy("g").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    named = F.transform("chunks", lambda c: F.struct(F.when(c["doc_id"] % 4 == 2, "").otherwise(c["doc_id"].cast("string")).alias("doc_id"), c["text"].alias("text"), c["page_number"].alias("page_number")))
    return grouped.select("g", prompt.context_block(named).alias("context"))


CONTEXT = f"""ctx AS (SELECT doc_id // 4 AS g, string_agg('[منبع شماره ' || i || ' | سند: ' || CASE WHEN doc_id % 4 = 2 THEN 'نامشخص' ELSE CAST(doc_id AS VARCHAR) END || ' | شماره صفحه: ' || p || ']' || chr(10) || {strip_sql('text')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS context
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) AS i, CASE WHEN doc_id % 4 = 1 THEN 0 ELSE doc_id % 7 END AS p FROM documents) GROUP BY 1)"""


@query("context_block", f"WITH {CONTEXT} SELECT g, md5(context) AS context_md5, length(context) AS n FROM ctx")
def context_block(spark, sf_dir):
    return _context(spark, sf_dir).select("g", F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("n"))


_HEAD, _TAIL = prompt.WITH_CONTEXT.replace("{question}", "who?").split("{context}")


@query("chatml_prompt", f"WITH {CONTEXT} SELECT g, md5('<|im_start|>system' || chr(10) || {_quoted(prompt.SYSTEM)} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {_quoted(_HEAD)} || context || {_quoted(_TAIL)} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt_md5 FROM ctx")
def chatml_prompt(spark, sf_dir):
    user = prompt.user_message(F.lit(" who? "), F.col("context"))
    nothing = F.array().cast("array<struct<role: string, content: string>>")
    return _context(spark, sf_dir).select("g", F.md5(prompt.chatml(prompt.messages(nothing, user))).alias("prompt_md5"))


MOCK = f"SELECT doc_id, 'بر اساس اسناد ارائه‌شده (صفحه 1):' || chr(10) || {strip_sql('text')} AS answer FROM documents"


@query("answer_tokens", f"SELECT doc_id, count(*) AS n, md5(string_agg(t || ' ', '' ORDER BY i)) AS tokens_md5 FROM (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(answer, ' ') AS s FROM ({MOCK}))) GROUP BY doc_id")
def answer_tokens(spark, sf_dir):
    answers = table(spark, sf_dir, "documents").select("doc_id", prompt.mock_answer(F.col("text"), F.lit(1)).alias("answer"))
    tokens = prompt.answer_tokens(answers, "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("position", "token")))
    return tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.transform(ordered, lambda x: x["token"]), "")).alias("tokens_md5"))


@query("joined_answer", f"SELECT doc_id, md5({strip_sql('answer')}) AS answer_md5 FROM ({MOCK})")
def joined_answer(spark, sf_dir):
    answers = table(spark, sf_dir, "documents").select("doc_id", prompt.mock_answer(F.col("text"), F.lit(1)).alias("answer"))
    return prompt.joined_answer(prompt.answer_tokens(answers, "doc_id"), "doc_id").select("doc_id", F.md5("answer").alias("answer_md5"))


def _messages(spark, sf_dir):
    day = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return table(spark, sf_dir, "conversations").select(F.col("turn").alias("id"), F.col("conv_id").alias("chat_id"), "role", F.col("text").alias("content"), (day + F.make_dt_interval(F.lit(0), F.lit(0), F.col("conv_id") * 7 % 911 + F.col("turn"))).alias("created_at"))


MESSAGES = "messages AS (SELECT turn AS id, conv_id AS chat_id, role, text AS content, TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 7 % 911 + turn AS INT)) AS created_at FROM conversations)"


@query("history_tail", f"WITH {MESSAGES} SELECT chat_id, id, role, {strip_sql('content')} AS content FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) AS r FROM messages WHERE role IN ('user', 'assistant') AND content <> '') WHERE r <= 6")
def history_tail(spark, sf_dir):
    return prompt.history_tail(_messages(spark, sf_dir), 3).select("chat_id", "id", "role", "content")


@query("history_unlimited", f"WITH {MESSAGES} SELECT chat_id, count(*) AS n FROM messages WHERE role IN ('user', 'assistant') AND content <> '' GROUP BY chat_id")
def history_unlimited(spark, sf_dir):
    return prompt.history_tail(_messages(spark, sf_dir), 0).groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"))


def _chats(spark, sf_dir):
    first = _messages(spark, sf_dir).groupBy("chat_id").agg(F.min_by("content", "id").alias("title"), F.min("created_at").alias("created_at"))
    return first.select(F.col("chat_id").alias("id"), "title", F.lit("#AEC6CF").alias("color"), "created_at", F.col("created_at").alias("updated_at"))


CHATS = f"{MESSAGES}, chats AS (SELECT chat_id AS id, arg_min(content, id) AS title, '#AEC6CF' AS color, min(created_at) AS created_at, max(created_at) AS updated_at FROM messages GROUP BY chat_id)"


@query("latest_chats", f"WITH {CHATS} SELECT id, color, updated_at, strftime(updated_at, '%H:%M') AS shown, row_number() OVER (ORDER BY updated_at DESC, id) AS place FROM chats ORDER BY place LIMIT 20")
def latest_chats(spark, sf_dir):
    from pyspark.sql import Window

    top = store.touched(_chats(spark, sf_dir), _messages(spark, sf_dir)).orderBy(F.desc("updated_at"), "id").limit(20)
    place = F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")).cast("long")
    return top.select("id", "color", F.to_timestamp_ntz(F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")).alias("updated_at"), F.date_format("updated_at", "HH:mm").alias("shown"), place.alias("place"))


@query("messages_in_order", f"WITH {MESSAGES} SELECT chat_id, md5(string_agg(chr(8207) || content, '|' ORDER BY id)) AS shown_md5 FROM messages GROUP BY chat_id")
def messages_in_order(spark, sf_dir):
    """Each message with a right-to-left mark in front, in order of id."""
    ordered = F.array_sort(F.collect_list(F.struct("id", F.concat(F.lit("‏"), "content").alias("shown"))))
    return _messages(spark, sf_dir).groupBy("chat_id").agg(F.md5(F.array_join(F.transform(ordered, lambda x: x["shown"]), "|")).alias("shown_md5"))


@query("title_search", f"WITH {CHATS} SELECT id FROM chats WHERE contains(lower(title), lower(trim(' Ti ')))")
def title_search(spark, sf_dir):
    return _chats(spark, sf_dir).where(F.lower("title").contains("Ti".strip().lower())).select("id")


FILES = "files AS (SELECT page_id AS id, page_id % 17 AS chat_id, CASE WHEN page_id % 3 = 0 THEN 'Report' || page_id % 40 || '.PDF' ELSE 'note' || page_id % 40 || '.txt' END AS filename, 'pending' AS status FROM pages)"


def _files(spark, sf_dir):
    number = (F.col("page_id") % 40).cast("string")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Report"), number, F.lit(".PDF"))).otherwise(F.concat(F.lit("note"), number, F.lit(".txt")))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 17).alias("chat_id"), name.alias("filename"), F.lit("pending").alias("status"))


@query("files_accepted", f"WITH {FILES} SELECT id, 'chat' || chat_id || '_' || filename AS stored_name, 'chat_' || chat_id AS collection FROM files WHERE lower(filename) LIKE '%.pdf'")
def files_accepted(spark, sf_dir):
    own = _files(spark, sf_dir).where(F.lower("filename").endswith(".pdf"))
    return own.select("id", F.concat(F.lit("chat"), F.col("chat_id").cast("string"), F.lit("_"), "filename").alias("stored_name"), F.concat(F.lit("chat_"), F.col("chat_id").cast("string")).alias("collection"))


@query("files_new", f"WITH {FILES} SELECT id FROM files f WHERE id >= 40 AND NOT EXISTS (SELECT 1 FROM files o WHERE o.id < 40 AND o.chat_id = f.chat_id AND o.filename = f.filename)")
def files_new(spark, sf_dir):
    """Uploads whose name their chat doesn't have yet."""
    files = _files(spark, sf_dir)
    return files.where("id >= 40").join(files.where("id < 40").select("chat_id", "filename"), ["chat_id", "filename"], "left_anti").select("id")


@query("files_delete_returning", f"WITH {FILES} SELECT id, 'chat' || chat_id || '_' || filename AS stored_path FROM files WHERE id IN (3, 4)")
def files_delete_returning(spark, sf_dir):
    gone = stored(spark, _files(spark, sf_dir), "files", "id").delete(F.col("id").isin(3, 4))
    return gone.select("id", F.concat(F.lit("chat"), F.col("chat_id").cast("string"), F.lit("_"), "filename").alias("stored_path"))


@query("files_update", f"WITH {FILES} SELECT id, CASE WHEN id = 5 THEN 'done' ELSE status END AS status FROM files")
def files_update(spark, sf_dir):
    own = stored(spark, _files(spark, sf_dir), "files", "id")
    own.update(F.col("id") == 5, status=F.lit("done"))
    return own.read().select("id", "status")


@query("files_in_order", f"WITH {FILES} SELECT chat_id, string_agg(filename, ',' ORDER BY id) AS names FROM files GROUP BY chat_id")
def files_in_order(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("chat_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "filename"))), lambda x: x["filename"]), ",").alias("names"))


@query("chat_delete_cascade", f"WITH {MESSAGES} SELECT chat_id, count(*) AS left_over FROM messages WHERE chat_id NOT IN (SELECT chat_id FROM messages WHERE role = 'system') GROUP BY chat_id")
def chat_delete_cascade(spark, sf_dir):
    """Deletes the chats that have a system message; their messages go with them."""
    messages = _messages(spark, sf_dir)
    left = store.cascade(messages, messages.where("role = 'system'").select("chat_id"), "chat_id", "chat_id")
    return left.groupBy("chat_id").agg(F.count(F.lit(1)).alias("left_over"))


@query("insert_with_ids", f"WITH {MESSAGES} SELECT CAST((SELECT max(chat_id) FROM messages) + row_number() OVER (ORDER BY item_id) AS BIGINT) AS id, item_id FROM benchmark")
def insert_with_ids(spark, sf_dir):
    existing = _messages(spark, sf_dir).select(F.col("chat_id").alias("id"))
    return store.next_ids(existing, table(spark, sf_dir, "benchmark").select("item_id"), ["item_id"]).select("id", "item_id")


@query("truncate_chats", f"WITH {CHATS} SELECT id, title FROM chats WHERE false")
def truncate_chats(spark, sf_dir):
    own = stored(spark, _chats(spark, sf_dir).select("id", "title"), "chats", "id")
    own.truncate()
    return own.read()


@query("collection_counts", "SELECT lang AS collection, count(*) AS chunks, count(*) > 0 AS has_chunks FROM documents GROUP BY lang UNION ALL SELECT 'none', 0, false")
def collection_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("collection"))
    return store.counts(docs, docs.union(spark.range(1).select(F.lit("none"))))


@query("collections", "SELECT DISTINCT 'chat_' || lang AS collection FROM documents")
def collections(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("chat_"), "lang").alias("collection")).distinct()


@query("collection_scan", "SELECT doc_id, md5(text) AS text_md5, source FROM documents WHERE lang = 'fr'")
def collection_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id", F.md5("text").alias("text_md5"), "source")


@query("clustered_scan", "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE lang = 'es' AND source IN ('src1', 'src3') UNION ALL SELECT doc_id, md5(text) FROM documents WHERE lang = 'en'")
def clustered_scan(spark, sf_dir):
    """Documents as chunks of their source, clustered on disk: two sources of one collection, and the whole of another; a missing one is empty."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("collection"), F.col("source").alias("doc_id"), F.col("doc_id").alias("id"), "text")
    held = layout.write_clustered(rows, folders.new_folder(spark, "clustered"), files=16)
    some = held.scan(spark, "es", ["src1", "src3", " "]).unionByName(held.scan(spark, "en")).unionByName(held.scan(spark, "none"))
    return some.select(F.col("id").alias("doc_id"), F.md5("text").alias("text_md5"))


@query("files_by_time", f"WITH {FILES} SELECT chat_id, string_agg(filename, ',' ORDER BY id * 37 % 101, id) AS names FROM files GROUP BY chat_id")
def files_by_time(spark, sf_dir):
    """Each chat's files in the order of their creation, then of their id."""
    at = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 37 % 101).cast("int"))
    files = _files(spark, sf_dir).withColumn("created_at", at)
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "id", "filename")))
    return files.groupBy("chat_id").agg(F.array_join(F.transform(ordered, lambda x: x["filename"]), ",").alias("names"))


@query("chat_rename", f"WITH {CHATS} SELECT id, CASE WHEN id % 10 = 4 THEN 'renamed' ELSE title END AS title, id % 10 = 4 AS moved FROM chats")
def chat_rename(spark, sf_dir):
    """A tenth of the chats get another title; these alone get a new time."""
    chats = _chats(spark, sf_dir)
    own = stored(spark, chats, "chats", "id")
    own.update(F.col("id") % 10 == 4, title=F.lit("renamed"))
    before = chats.select("id", F.col("updated_at").alias("old"))
    return own.read().join(before, "id").select("id", "title", (F.col("updated_at") > F.col("old")).alias("moved"))


STORE = "old AS (SELECT lang AS collection, source AS chunk_id, doc_id AS seq, n_chars FROM documents WHERE doc_id % 2 = 0), new AS (SELECT lang AS collection, source AS chunk_id, doc_id AS seq, n_chars FROM documents WHERE doc_id % 2 = 1)"


@query("upsert_latest", f"WITH {STORE} SELECT * FROM (SELECT * FROM old UNION ALL SELECT * FROM new) QUALIFY row_number() OVER (PARTITION BY collection, chunk_id ORDER BY seq DESC) = 1")
def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("collection"), F.col("source").alias("chunk_id"), F.col("doc_id").alias("seq"), "n_chars")
    return store.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ["collection", "chunk_id"])


@query("delete_document", "SELECT lang, count(*) AS n FROM documents WHERE NOT (lang = 'en' AND source = 'src1') GROUP BY lang")
def delete_document(spark, sf_dir):
    own = stored(spark, table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "store", "doc_id")
    own.delete((F.col("lang") == "en") & (F.col("source") == "src1"))
    return own.read().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("drop_collection", "SELECT lang, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY lang")
def drop_collection(spark, sf_dir):
    return store.delete(table(spark, sf_dir, "documents"), F.col("lang") == "de").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("drop_all", "SELECT count(DISTINCT lang) AS dropped, CAST(0 AS BIGINT) AS left_over FROM documents")
def drop_all(spark, sf_dir):
    own = stored(spark, table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("collection")), "store", "doc_id")
    n = own.drop_collections()
    return own.read().agg(F.lit(n).cast("long").alias("dropped"), F.count(F.lit(1)).alias("left_over"))


@query("switch_model", "WITH d AS (SELECT count(*) AS n FROM documents) SELECT 0 AS step, 'written' AS effect, n AS chunks FROM d UNION ALL SELECT 1, 'nothing', n FROM d UNION ALL SELECT 2, 'rejected', n FROM d UNION ALL SELECT 3, 'cleared', 0")
def switch_model(spark, sf_dir):
    """A store's first model, the same again, an unknown one and another known one: the effect, and the chunks that are left."""
    own = stored(spark, table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("collection")), "store", "doc_id")
    passport, steps = folders.new_folder(spark, "passport"), []
    for i, wanted in enumerate(["bge-m3", "bge-m3", "nothing", "e5-small"]):
        effect = store.switch_model(spark, wanted, passport, own, [])
        steps.append((i, effect, own.read().count()))
    return spark.createDataFrame(steps, "step int, effect string, chunks bigint")


@query("json_documents", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS filename, CAST(1 AS INT) AS page_number, md5(text) AS text_md5 FROM documents")
def json_documents(spark, sf_dir):
    """Documents written as JSON and scanned again with their declared schema."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("filename"), F.lit("real").alias("source_type"), F.lit(1).alias("page_number"), F.col("text").alias("raw_text"))
    folder = folders.new_folder(spark, "documents")
    readers.write_documents(pages, folder)
    return readers.pages_of(readers.read_json(spark, folder, schemas.DOCUMENT, lines=True)).select("doc_id", "filename", "page_number", F.md5("raw_text").alias("text_md5"))


@query("ingest_stream", "SELECT lang AS collection, source AS chunk_id, doc_id AS seq, md5(text) AS text_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id DESC) = 1")
def ingest_stream(spark, sf_dir):
    """A stream of JSON files, upserted by key into a table; of equal keys the latest row stays."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("collection"), F.col("source").alias("chunk_id"), F.col("doc_id").alias("seq"), "text")
    arrivals, checkpoint = folders.new_folder(spark, "arrivals"), folders.new_folder(spark, "stream")
    own = store.Table(spark, folders.new_folder(spark, "store"), rows.schema, ["collection", "chunk_id"], order="seq")
    for half in (0, 1):
        rows.where(f"pmod(seq, 2) = {half}").write.mode("append").json(arrivals)
        ingest.start_ingest(spark, arrivals, rows.schema, own, checkpoint).awaitTermination()
    return own.read().select("collection", "chunk_id", "seq", F.md5("text").alias("text_md5"))


@query("partial_upsert", "SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN md5(coalesce(text, '') || source) ELSE md5(text) END AS text_md5 FROM documents WHERE doc_id % 1000 <> 7")
def partial_upsert(spark, sf_dir):
    """A stored table of all documents of which a hundredth is upserted and a thousandth deleted; only their rows are written."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    own = stored(spark, rows, "store", "doc_id")
    own.upsert(rows.where("doc_id % 100 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), "source")))
    own.delete(F.col("doc_id") % 1000 == 7)
    return own.read().select("doc_id", F.md5("text").alias("text_md5"))


@query("chat_delete_everywhere", f"""WITH {MESSAGES}, {FILES}, gone AS (SELECT DISTINCT chat_id FROM messages WHERE role = 'system')
SELECT 'chats' AS name, count(DISTINCT chat_id) AS left_over FROM messages WHERE chat_id NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'messages', count(*) FROM messages WHERE chat_id NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'files', count(*) FROM files WHERE chat_id NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'chunks', count(*) FROM documents WHERE doc_id % 50 NOT IN (SELECT * FROM gone)""")
def chat_delete_everywhere(spark, sf_dir):
    """Chats with a system message go from four tables in one commit, with their messages, files and chunks."""
    messages = _messages(spark, sf_dir)
    tables = {
        "chats": messages.select(F.col("chat_id").alias("id")).distinct(),
        "messages": messages.select("chat_id", "id", "role"),
        "files": _files(spark, sf_dir).select("id", "chat_id"),
        "chunks": table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("chat_id"), "text"),
    }
    keys = {"chats": ("id",), "messages": ("chat_id", "id"), "files": ("id",), "chunks": ("doc_id",)}
    held = store.Store(spark, folders.new_folder(spark, "chats"), {name: store.Spec(rows.schema, keys[name]) for name, rows in tables.items()})
    with held.transaction() as change:
        for name, rows in tables.items():
            change.replace(name, rows)
    store.delete_chats_of(held, messages.where("role = 'system'").select("chat_id"), {"messages": "chat_id", "files": "chat_id", "chunks": "chat_id"})
    counts = [held.read(name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("left_over")) for name in tables]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


_KEYS = ", ".join(f"'{k}'" for k in readers.EMBEDDING_MODELS)
_N = len(readers.EMBEDDING_MODELS)


@query("model_switch", f"WITH asked AS (SELECT doc_id, [{_KEYS}][doc_id % {_N + 1} + 1] AS active, coalesce([{_KEYS}][doc_id // 5 % {_N + 1} + 1], 'nothing') AS wanted FROM documents) SELECT doc_id, active, wanted, CASE WHEN NOT list_contains([{_KEYS}], wanted) THEN 'rejected' WHEN active IS NULL THEN 'written' WHEN active = wanted THEN 'nothing' ELSE 'cleared' END AS effect FROM asked")
def model_switch(spark, sf_dir):
    """Each document's id stands for a store's active model and for the one that is asked for."""
    keys = F.array(*map(F.lit, readers.EMBEDDING_MODELS))
    active, wanted = F.get(keys, F.col("doc_id") % (_N + 1)), F.coalesce(F.get(keys, F.expr(f"doc_id div 5 % {_N + 1}")), F.lit("nothing"))
    asked = table(spark, sf_dir, "documents").select("doc_id", active.alias("active"), wanted.alias("wanted"))
    return asked.select("doc_id", "active", "wanted", store.model_switch(F.col("active"), F.col("wanted"), F.array_contains(keys, F.col("wanted"))).alias("effect"))


@query("missing_models", f"WITH known AS (SELECT unnest([{_KEYS}]) AS model_key), here AS (SELECT DISTINCT lang, [{_KEYS}][doc_id % 7 + length(lang) + 1] AS model_key FROM documents) SELECT lang, k.model_key FROM (SELECT DISTINCT lang FROM documents) l, known k WHERE NOT EXISTS (SELECT 1 FROM here h WHERE h.lang = l.lang AND h.model_key = k.model_key)")
def missing_models(spark, sf_dir):
    """For each collection, the registered models that none of its documents has."""
    keys = F.array(*map(F.lit, readers.EMBEDDING_MODELS))
    docs = table(spark, sf_dir, "documents")
    here = docs.select("lang", F.get(keys, F.col("doc_id") % 7 + F.length("lang")).alias("model_key")).distinct()
    known = readers.registry(spark).where("kind = 'embedding'").select("model_key")
    return docs.select("lang").distinct().crossJoin(F.broadcast(known)).join(here, ["lang", "model_key"], "left_anti")


@query("page_texts", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script\b.*?</script>|style\b.*?</style>)', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS text_md5 FROM pages")
def page_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(readers.html_text(F.col("html"))).alias("text_md5"))


@query("clean_texts")
def clean_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("text_md5"))


def _lengths(texts: list[str]) -> list[list[float]]:
    """Stands for a model: a vector from a text's length and its first letter."""
    return [[float(len(t)), float(ord(t[-1])) if t else 1.0] for t in texts]


@query("ingest_progress", "WITH n AS (SELECT count(*) AS documents FROM documents) SELECT CAST(stage AS INT) AS stage, documents, progress FROM n, (VALUES (0, 0.10::DOUBLE), (1, 0.30::DOUBLE), (2, 0.55::DOUBLE), (3, 0.80::DOUBLE), (4, 0.95::DOUBLE), (5, 1.00::DOUBLE)) t(stage, progress)")
def ingest_progress(spark, sf_dir):
    """A run over all documents as a stream of files: what each stage counted while they passed, and the share at its end."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("collection"), F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("doc_id").alias("seq"))
    arrivals = folders.new_folder(spark, "arrivals")
    docs.repartition(4).write.json(arrivals)
    own = store.Table(spark, folders.new_folder(spark, "store"), "collection string, chunk_id string, doc_id string, text string, embedding array<float>, seq long", ["collection", "chunk_id"], order="seq")
    told = ingest.ingest_with_progress(spark, arrivals, docs.schema, own, folders.new_folder(spark, "stream"), total=docs.count(), embed=_lengths)
    return told.groupBy("stage").agg(F.max("done").alias("documents"), F.max("progress").alias("progress"))


@query("guards", f"WITH {FILES}, n AS (SELECT chat_id, count(*) AS n FROM files GROUP BY chat_id) SELECT c.conv_id, CASE WHEN coalesce(n, 0) = 0 THEN '{ingest.NO_DOCUMENTS}' WHEN c.conv_id % 2 = 0 THEN '{ingest.WAITING}' END AS message FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON c.conv_id = n.chat_id")
def guards(spark, sf_dir):
    n = _files(spark, sf_dir).groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"))
    chats = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    joined = chats.join(n, F.col("conv_id") == F.col("chat_id"), "left")
    share = F.when(F.col("conv_id") % 2 == 0, 0.55).otherwise(1.0)
    return joined.select("conv_id", ingest.guard(share, F.col("n")).alias("message"))


@query("guard_stream", f"""WITH {FILES}, n AS (SELECT chat_id, count(*) AS n, bool_or(id % 2 = 1) AS working FROM files GROUP BY chat_id), c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id AS chat_id, conv_id || 'a' AS question_id, CASE WHEN n IS NULL THEN '{ingest.NO_DOCUMENTS}' ELSE '{ingest.WAITING}' END AS message FROM c LEFT JOIN n ON conv_id = chat_id
UNION ALL SELECT conv_id, conv_id || 'b', CASE WHEN n IS NULL THEN '{ingest.NO_DOCUMENTS}' WHEN working THEN '{ingest.WAITING}' END FROM c LEFT JOIN n ON conv_id = chat_id
UNION ALL SELECT conv_id, conv_id || 'c', CASE WHEN n IS NULL OR NOT coalesce(done, false) THEN '{ingest.NO_DOCUMENTS}' END FROM c LEFT JOIN n ON conv_id = chat_id LEFT JOIN (SELECT chat_id AS d, true AS done FROM files WHERE id % 2 = 0 GROUP BY chat_id) ON conv_id = d""")
def guard_stream(spark, sf_dir):
    """All chats ask at minute 5, while all files are in work, at minute 20, when every second one is done, and at minute 200, when the others are lost."""
    at = lambda minute: F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(minute // 60), F.lit(minute % 60), F.lit(0))
    files, none = _files(spark, sf_dir), F.lit(None).cast("string")
    told = lambda rows, minute, share: rows.select("chat_id", at(minute).alias("time"), F.col("id").cast("string").alias("file_id"), F.lit(share).alias("progress"), none.alias("question_id"))
    chats = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    asks = lambda minute, mark: chats.select(F.col("conv_id").alias("chat_id"), at(minute).alias("time"), none.alias("file_id"), F.lit(None).cast("double").alias("progress"), F.concat(F.col("conv_id").cast("string"), F.lit(mark)).alias("question_id"))
    events = told(files, 0, 0.55).unionByName(asks(5, "a")).unionByName(told(files.where("id % 2 = 0"), 10, 1.0)).unionByName(asks(20, "b")).unionByName(asks(200, "c"))
    arrivals, out = folders.new_folder(spark, "events"), folders.new_folder(spark, "decisions")
    events.write.json(arrivals)
    guard.start_guard(spark, arrivals, out, folders.new_folder(spark, "guard"), files_a_batch=1_000_000).awaitTermination()
    return spark.read.schema(guard.DECISIONS).parquet(out)


@query("hit_at_k", "WITH qa AS (SELECT item_id, [item_id, item_id + 1, item_id * 3] AS supporting FROM benchmark), r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents) SELECT item_id, coalesce(bool_or(place <= 50), false) AS hit, round(coalesce(max(1E0 / place), 0), 9) AS reciprocal FROM (SELECT item_id, unnest(supporting) AS doc_id FROM qa) s LEFT JOIN r USING (doc_id) GROUP BY item_id")
def hit_at_k(spark, sf_dir):
    """Questions with supporting chunks against one ranking of all: hit among the first 50, and reciprocal rank, however far down."""
    wanted = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.col("item_id"), F.col("item_id") + 1, F.col("item_id") * 3)).alias("doc_id"))
    joined = store.ranks_of(wanted, table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], "doc_id")
    return joined.groupBy("item_id").agg(F.coalesce(F.bool_or(F.col("place") <= 50), F.lit(False)).alias("hit"), F.round(F.coalesce(F.max(1 / F.col("place")), F.lit(0.0)), 9).alias("reciprocal"))
