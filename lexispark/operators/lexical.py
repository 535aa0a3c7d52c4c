"""BM25 (Okapi) over a corpus of (id, text)."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, without_stopwords

K1, B, EPSILON = 1.5, 0.75, 0.25


def tokenised(corpus: DataFrame, id_column: str = "doc_id", text_column: str = "text", stopwords: bool = True) -> DataFrame:
    words = tokens(F.col(text_column))
    return corpus.select(F.col(id_column).alias("id"), (without_stopwords(words) if stopwords else words).alias("words"))


#: Entries that count texts and words beside the terms, which are never empty or blank.
TEXTS, WORDS = "", " "


def term_statistics(words: DataFrame) -> DataFrame:
    """term, df, idf, average (words a text): negative idf become a quarter of the mean over the vocabulary.

    One pass over the texts counts terms, texts and words, before the shuffle; what follows reads that one shuffle's result.
    """
    return weighted(words.select(F.explode(entries(F.col("words"))).alias("e")).groupBy(F.col("e.term").alias("term")).agg(F.sum("e.n").alias("df")))


def entries(words: Column) -> Column:
    """What a text adds to the counts: 1 for each of its terms and for itself, and its number of words."""
    entry = lambda term, n: F.struct(term.alias("term"), n.cast("long").alias("n"))
    return F.concat(F.transform(F.array_distinct(words), lambda t: entry(t, F.lit(1))), F.array(entry(F.lit(TEXTS), F.lit(1)), entry(F.lit(WORDS), F.size(words))))


def weighted(counted: DataFrame) -> DataFrame:
    """The statistics from counts (term, df) that hold those of texts and words."""
    whole = counted.agg(F.max(F.when(F.col("term") == TEXTS, F.col("df"))).alias("n"), F.max(F.when(F.col("term") == WORDS, F.col("df"))).alias("n_words"))
    raw = counted.crossJoin(F.broadcast(whole)).withColumn("raw", F.when(~F.col("term").isin(TEXTS, WORDS), F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))
    known = raw.crossJoin(F.broadcast(mean)).where(F.col("raw").isNotNull() & F.col("n").isNotNull())
    return known.select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), F.try_divide("n_words", "n").alias("average"))


def scores(words: DataFrame, query: list[str], statistics: DataFrame | None = None) -> DataFrame:
    """id, score > 0 for the query's tokens, duplicates counted. ``statistics`` may be kept from an unfiltered corpus of the same texts."""
    wanted = Counter(query)
    if not wanted:
        return words.select("id", F.lit(0.0).alias("score")).limit(0)
    statistics = term_statistics(words) if statistics is None else statistics
    terms = statistics.where(F.col("term").isin(list(wanted)))
    times = F.element_at(F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair)), F.col("term"))
    # Only the query's terms leave a text, with their counts.
    listed = F.array(*map(F.lit, sorted(wanted)))
    found = F.filter(F.transform(listed, lambda t: F.struct(t.alias("term"), F.size(F.filter("words", lambda w: w == t)).alias("tf"))), lambda x: x["tf"] > 0)
    postings = words.where(F.arrays_overlap("words", listed)).select("id", F.size("words").alias("dl"), F.explode(found).alias("p")).select("id", "dl", "p.*")
    joined = postings.join(F.broadcast(terms), "term")
    part = times * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.try_divide(F.col("dl"), F.col("average"))))
    return joined.groupBy("id").agg(F.sum(part).alias("score")).where("score > 0")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best with bm25_rank from 1; ties in order of id. Limited before it is ranked, so no sort of everything."""
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("bm25_rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("int"))
