"""Benchmark decontamination by a prefix-filtered set join, in DataFrame and SQL functions only.

A window is ``window`` consecutive words of an item (all of them in a shorter
item). Equal windows of any items are one, whose items are looked up after its places are known. It is a set of 3-word shingles (shorter where the item is), all of which must
occur, so its prefix is one shingle: the rarest by its count over the whole
corpus. Only that shingle is joined. The place of the shingle in the window says
where the window must begin in the document (positional bound) and that it must
end inside it (length bound); then the words themselves are compared.

Two passes read the texts. The first counts the shingles of windows. In the second the exploded words stay inside
one generated stage: explode, hash probe, bounds and comparison are one pass without a shuffle, and only true
occurrences leave it, with a row for each document that has its number of words.
The windows are broadcast when their words are counted to be at most ``broadcast_bytes``.
With a larger benchmark, positions whose hash no window has stay in their task, the others are counted before they are dealt; places and hashes alone are shuffled
on the hash, within bounds; then the words of documents
with such a place are fetched and compared.

Cases: a null or wordless text has no words and no hits. Items without words are
ignored; equal items all count. Rows that share doc_id and text get the same
result each; null doc_ids are kept. Texts of any length are split whole. Empty tables give no rows, or no hits. Other
columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, documents, materialize, may_hold

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 3


def ascii_lower(text: Column) -> Column:
    return F.when(F.octet_length(text) != F.length(text), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def split_words(text: Column) -> Column:
    """Words in order; an empty string may stand first or last, where separators do."""
    return F.split(ascii_lower(text), SEPARATORS)


def _hash_at(words: str, position: str, k: int) -> Column:
    return F.expr(f"xxhash64({', '.join(f'get({words}, {position} + {i})' for i in range(k))})")


def benchmark_windows(items: DataFrame, window: int, id_column: str, text_column: str) -> DataFrame:
    """words, k (shingle length), items (ids in order), owners (a name for these items): one row for each different sequence of words."""
    words = items.select(F.col(id_column).cast("string").alias("item_id"), F.filter(split_words(F.col(text_column)), lambda w: w != "").alias("all_words")).where("size(all_words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("all_words") - window, F.lit(0)))
    each = words.select("item_id", "all_words", F.explode(starts).alias("w")).select("item_id", F.slice("all_words", F.col("w") + 1, F.lit(window)).alias("words"))
    owned = each.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return owned.select("words", F.least(F.size("words"), F.lit(SHINGLE)).alias("k"), "items", F.sha2(F.to_json("items"), 256).alias("owners"))


@dataclass
class Places:
    """Where windows occur: ``rows`` has doc_id, text_key (hash of the text), n_words, start, length, owners: a row with ``n_words`` for each
    row of the documents, and one with the rest for each place of a window. ``owners`` has the items of each name."""

    rows: DataFrame
    owners: DataFrame


def find_places(docs: DataFrame, items: DataFrame, *, window: int = 13, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text", broadcast_bytes: int = 32 << 20) -> Places:
    """At a place in a document a window of one length is one sequence of words, so a document has no more rows than words for each length there is."""
    spark = docs.sparkSession
    windows, _ = materialize(benchmark_windows(items, window, item_id_column, item_text_column), "windows")
    held = F.octet_length(F.array_join("words", " ")) + 16 * F.size("words") + F.octet_length(F.array_join("items", " ")) + 16 * F.size("items") + 160
    shape = windows.agg(F.sum(held).alias("held"), F.collect_set("k").alias("ks"), F.count(F.lit(1)).alias("n")).first()
    fits_in_task = (shape.held or 0) <= broadcast_bytes
    small = F.broadcast if fits_in_task else (lambda df: df)
    shingles = windows.select("words", "k", "owners", F.posexplode(F.expr("transform(sequence(0, size(words) - k), o -> slice(words, o + 1, k))")).alias("offset", "shingle"))
    texts = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_key"), split_words(F.col(text_column)).alias("doc_words"))
    texts = texts.withColumn("n_doc", F.greatest(F.coalesce(F.size("doc_words"), F.lit(0)), F.lit(0)))
    whole = texts.where("n_doc > 0")
    empty_ends = F.when(F.get("doc_words", F.lit(0)) == "", 1).otherwise(0) + F.when((F.col("n_doc") > 1) & (F.get("doc_words", F.col("n_doc") - 1) == ""), 1).otherwise(0)
    n_words = F.when(F.col("at") == -1, (F.col("n_doc") - F.when(F.col("n_doc") > 0, empty_ends).otherwise(0)).cast("long"))
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.size("words") <= F.col("n_doc"))
    same = F.slice("doc_words", start + 1, F.size("words")) == F.col("words")
    places = ["doc_id", "text_key", n_words.alias("n_words"), start.alias("start"), F.size("words").alias("length"), "owners"]
    found, done = None, []
    for k in sorted(shape.ks) or [SHINGLE]:
        of_k = shingles.where(F.col("k") == k).withColumn("h", _hash_at("shingle", "0", k))
        each = whole.select("*", F.explode(F.expr("sequence(0, n_doc - 1)")).alias("at")).withColumn("at_h", _hash_at("doc_words", "at", k))
        different = of_k.select(F.col("h").alias("at_h")).distinct()
        if fits_in_task:
            counts = each.select("at_h").join(F.broadcast(different), "at_h").groupBy("at_h").agg(F.count(F.lit(1)).alias("n"))
        else:
            # What no window has doesn't leave its task, and the rest is counted before it is dealt.
            counts = each.select("at_h").where(may_hold(different, "at_h", shape.n * window)).groupBy("at_h").agg(F.count(F.lit(1)).alias("n")).join(different, "at_h")
        rarest = of_k.join(counts, F.col("h") == F.col("at_h")).groupBy("words", "owners").agg(F.min_by(F.struct("h", "offset"), F.struct("n", "offset")).alias("r"))
        prefix, folder = materialize(rarest.select("owners", "words", F.col("r.h").alias("h"), F.col("r.offset").alias("offset")), "rarest")
        done.append(folder)
        if fits_in_task and found is None:
            # Place -1 stands for the document itself and matches nothing.
            every = texts.select("*", F.explode(F.expr("sequence(-1, n_doc - 1)")).alias("at")).withColumn("at_h", F.when(F.col("at") >= 0, _hash_at("doc_words", "at", k)))
            hits = every.join(F.broadcast(prefix), (F.col("at_h") == F.col("h")) & F.when(fits, same).otherwise(False), "left").where("at = -1 or words is not null").select(*places)
        elif fits_in_task:
            hits = each.join(F.broadcast(prefix), (F.col("at_h") == F.col("h")) & F.when(fits, same).otherwise(False)).select(*places)
        else:
            may = each.where(may_hold(prefix.select(F.col("h").alias("at_h")), "at_h", shape.n))
            near = may.select(F.col("doc_id").alias("near_id"), F.col("text_key").alias("near_key"), "at", "at_h", "n_doc").join(prefix, (F.col("at_h") == F.col("h")) & fits)
            near, folder = materialize(near.withColumn("near", F.xxhash64("near_id", "near_key")).drop("n_doc"), "near")
            done.append(folder)
            wanted = near.select("near").distinct()
            held_words = whole.withColumn("mark", F.xxhash64("doc_id", "text_key")).where(may_hold(wanted.withColumnRenamed("near", "mark"), "mark", wanted.count())).dropDuplicates(["doc_id", "text_key"])
            hits = near.join(held_words, F.col("near_id").eqNullSafe(F.col("doc_id")) & (F.col("near_key") == F.col("text_key"))).where(same).select(*places)
            if found is None:
                hits = texts.withColumn("at", F.lit(-1)).select("doc_id", "text_key", n_words.alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("owners")).unionByName(hits)
        found = hits if found is None else found.unionByName(hits)
    rows, _ = materialize(found, "places")
    discard(spark, *done)
    return Places(rows, small(windows.select("owners", "items").dropDuplicates(["owners"])))


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 13, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Per document: doc_id, text_key (hash of its text), n_words, n_hit, items (ids as sorted strings), contaminated (a twentieth of its words or more is hit)."""
    places = find_places(docs, items, window=window, id_column=id_column, text_column=text_column, item_id_column=item_id_column, item_text_column=item_text_column, broadcast_bytes=broadcast_bytes)
    hit = places.rows.where("length is not null")
    grouped = hit.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    # Windows of the same items are told apart no more: a document meets each set of items once.
    owned = hit.select("doc_id", "text_key", "owners").distinct().join(places.owners, "owners")
    owned = owned.groupBy(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    grouped = grouped.join(owned, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")))
    # Spans in order of their starts: each adds what lies beyond the end reached so far.
    covered = F.expr(
        "aggregate(array_sort(spans), named_struct('n', 0L, 'end', 0), (s, x) -> named_struct('n', s.n + greatest(0, x.start + x.length - greatest(s.end, x.start)), 'end', greatest(s.end, x.start + x.length)), s -> s.n)"
    )
    hits = grouped.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), covered.alias("n_hit"), "items")
    every = places.rows.where("n_words is not null").select("doc_id", "text_key", "n_words")
    both = every.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return both.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, *, window: int = 13, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all columns."""
    found = decontaminate(docs, items, window=window, id_column=id_column, text_column=text_column).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    # All columns travel in one struct, so their names can't clash with these.
    keyed = docs.select(F.col(id_column).alias("key_id"), F.xxhash64(text_column).alias("key"), F.struct("*").alias("row"))
    return keyed.join(found, F.col("key_id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key")), "left_anti").select("row.*")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s + 1 : s + 13], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM doc, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, a.n, item_id FROM place a JOIN win USING (t)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS j FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(j, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
