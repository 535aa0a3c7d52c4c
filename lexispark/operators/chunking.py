"""Overlapping character windows.

A pattern cuts all windows of a text in one pass: a look-ahead takes a window, the match itself moves on by a step.
What follows holds windows, never again the text they come from, so the time grows with the text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, strip, word_count


def _steps(size: int, overlap: int) -> int:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    return size - overlap


def window_count(text: Column, size: int, overlap: int) -> Column:
    """How many windows a text has: none without text, and none that only repeats the overlap of the one before."""
    return F.when(F.length(text) > 0, F.floor(F.greatest(F.length(text) - overlap - 1, F.lit(0)) / _steps(size, overlap)) + 1).otherwise(0).cast("int")


def _cut(text: Column, size: int, overlap: int) -> Column:
    """The windows of a text, in order."""
    every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{_steps(size, overlap)}}}"), F.lit(1))
    return F.slice(every, F.lit(1), window_count(text, size, overlap))


def windows(pages: DataFrame, *, size: int = 80, overlap: int = 20, text_column: str = "text") -> DataFrame:
    """One row for each window of a page: char_start, char_end and window in place of the text. Empty pages have none."""
    step, rest = _steps(size, overlap), [c for c in pages.columns if c != text_column]
    text = F.col(text_column)
    cut = pages.select(*rest, F.length(text).alias("char_end"), F.posexplode(_cut(text, size, overlap)).alias("char_start", "window"))
    start = F.col("char_start") * step
    return cut.select(*rest, start.alias("char_start"), F.least(start + size, F.col("char_end")).alias("char_end"), "window")


def chunk_pages(pages: DataFrame, *, size: int = 80, overlap: int = 20) -> DataFrame:
    """doc_id, page_number, text to chunks. chunk_index counts over all pages of a document, from 0.

    Each page's number of windows is known before they are made, so the index takes a
    window over pages, not over chunks.
    """
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    counted = pages.select("doc_id", "page_number", "text", F.coalesce(F.sum(window_count(F.col("text"), size, overlap)).over(before), F.lit(0)).alias("first"))
    cut = windows(counted, size=size, overlap=overlap)
    return _chunks(cut, (F.col("first") + F.col("char_start") / _steps(size, overlap)).cast("int"))


def _chunks(cut: DataFrame, index: Column) -> DataFrame:
    return cut.select(
        chunk_id(F.col("doc_id"), index).alias("chunk_id"), "doc_id", index.alias("chunk_index"), strip(F.col("window")).alias("text"), "page_number", F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"), word_count(F.col("window")).cast("int").alias("token_count"),
    )


def chunk_documents(documents: DataFrame, *, size: int = 80, overlap: int = 20, pages_column: str = "pages") -> DataFrame:
    """Chunks of documents that hold their pages as an array of (page_number, text), in order.

    A chunk's index is its place among all windows of the row, so no text is shuffled and none is copied for each of its windows.
    """
    step = _steps(size, overlap)

    def of_page(page: Column) -> Column:
        place = lambda i: i * step
        return F.transform(_cut(page["text"], size, overlap), lambda w, i: F.struct(page["page_number"].alias("page_number"), place(i).alias("char_start"), (place(i) + F.length(w)).alias("char_end"), w.alias("window")))

    every = F.flatten(F.filter(F.transform(pages_column, of_page), lambda x: x.isNotNull()))
    each = documents.select("doc_id", F.posexplode(every).alias("nth", "w")).select("doc_id", "nth", "w.*")
    return _chunks(each, F.col("nth"))


def read_chunks(spark, path: str, *, lines: bool = False) -> DataFrame:
    """Chunks from JSON with their declared schema; ``token_count`` is counted where the file has none."""
    from .. import schemas
    from ..sources.readers import read_json

    return read_json(spark, path, schemas.CHUNK, lines=lines).withColumn("token_count", F.coalesce("token_count", word_count(F.col("text"))))
