"""Sources: page documents, chunks and questions as JSON, scanned files through a pluggable parser, HTML pages, the model registries and the passport."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import document_id

# Embedding models by key, with repository and dimension.
EMBEDDING_MODELS = {
    "e5-small": ("intfloat/multilingual-e5-small", 384),
    "qwen3-emb-4b": ("Qwen/Qwen3-Embedding-4B", 2560),
    "bge-m3": ("BAAI/bge-m3", 1024),
    "octen-emb-8b": ("Octen/Octen-Embedding-8B", 4096),
    "qwen3-emb-8b": ("Qwen/Qwen3-Embedding-8B", 4096),
    "snowflake-arctic-l": ("Snowflake/snowflake-arctic-embed-l-v2.0", 1024),
    "f2llm-4b": ("codefuse-ai/F2LLM-v2-4B", 2560),
    "e5-large": ("intfloat/multilingual-e5-large", 1024),
    "e5-base": ("intfloat/multilingual-e5-base", 768),
    "fa-sentence": ("MirSamanPR/fa-sentence-v2", 768),
    "minilm": ("sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2", 384),
}
# What a passport says of each embedding model.
DESCRIPTIONS = {
    "e5-small": "مدل بسیار سبک و سریع E5 - عالی برای تست و سیستم محلی",
    "qwen3-emb-4b": "مدل بسیار قوی و مدرن سری کوئن ۳ برای امبدینگ",
    "bge-m3": "رتبه ۲ cheRAGh - چندزبانه همه‌فن‌حریف با درک عمیق فارسی",
    "octen-emb-8b": "مدل بسیار بزرگ و قدرتمند ۸ میلیاردی برای ارزیابی نهایی",
    "qwen3-emb-8b": "نسخه ۸ میلیارد پارامتری کوئن ۳ برای بیشترین دقت معنایی",
    "snowflake-arctic-l": "مدل قدرتمند اسنوفلیک نسخه ۲ برای جستجوی دقیق معنایی",
    "f2llm-4b": "مدل تخصصی بر پایه LLM برای بازنمایی برداری",
    "e5-large": "رتبه ۱ cheRAGh - بسیار دقیق در متون چندزبانه",
    "e5-base": "تعادل عالی بین سرعت، حافظه و دقت معنایی",
    "fa-sentence": "رتبه ۳ cheRAGh - مدل آموزش‌دیده اختصاصی برای زبان فارسی",
    "minilm": "بسیار سبک و سریع، مناسب سیستم‌های ضعیف با رم پایین",
}
# Language models by key, with repository and file.
LANGUAGE_MODELS = {
    "qwen-3b": ("Qwen/Qwen2.5-3B-Instruct-GGUF", "qwen2.5-3b-instruct-q4_k_m.gguf"),
    "qwen-7b": ("Qwen/Qwen2.5-7B-Instruct-GGUF", "qwen2.5-7b-instruct-q4_k_m.gguf"),
    "qwen-3.5-8b": ("Qwen/Qwen3.5-8B-GGUF", "qwen3.5-8b-q4_k_m.gguf"),
    "deepseek-14b": ("deepseek-ai/DeepSeek-R1-Distill-Qwen-14B-GGUF", "deepseek-r1-distill-qwen-14b-q4_k_m.gguf"),
}


def read_json(spark: SparkSession, path: str, schema: str, *, lines: bool = False) -> DataFrame:
    """A JSON array or object per file, or per line, so that a large file is split; a record that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def pages_of(documents: DataFrame) -> DataFrame:
    """One row a page; documents without pages give none."""
    return documents.select("doc_id", "filename", "source_type", F.explode("pages").alias("page")).select("doc_id", "filename", "source_type", "page.page_number", "page.raw_text")


def scan_files(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], source_type: str = "real", pattern: str = "*.pdf") -> DataFrame:
    """Files to pages with the parser given: doc_id, filename, source_type, page_number (from 1), raw_text. Blank pages stay, as empty texts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    named = files.select(document_id(name, F.col("length")).alias("doc_id"), name.alias("filename"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                texts = parse(row.content)
                yield pd.DataFrame({"doc_id": row.doc_id, "filename": row.filename, "source_type": source_type, "page_number": range(1, len(texts) + 1), "raw_text": [t or "" for t in texts]})

    return named.mapInPandas(run, "doc_id string, filename string, source_type string, page_number int, raw_text string")


def html_text(html: Column) -> Column:
    """Text of an HTML page: without scripts, styles and tags, spaces made single."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def registry(spark: SparkSession) -> DataFrame:
    rows = [(k, "embedding", repo, dim, None) for k, (repo, dim) in EMBEDDING_MODELS.items()] + [(k, "language", repo, None, file) for k, (repo, file) in LANGUAGE_MODELS.items()]
    return spark.createDataFrame(rows, "model_key string, kind string, repo_id string, dimension int, filename string")


def read_passport(spark: SparkSession, path: str) -> str | None:
    """The store's embedding model; None where there is no readable passport."""
    from pyspark.errors import PySparkException

    try:
        row = spark.read.schema(schemas.PASSPORT).option("multiLine", True).json(path).first()
    except PySparkException:
        return None
    return row.embedding_model if row else None


def write_passport(spark: SparkSession, path: str, model_key: str) -> None:
    _, dimension = EMBEDDING_MODELS.get(model_key, (None, None))
    spark.createDataFrame([(model_key, dimension, "cosine", None, DESCRIPTIONS.get(model_key, ""))], schemas.PASSPORT).coalesce(1).write.mode("overwrite").json(path)


def write_documents(pages: DataFrame, path: str) -> None:
    """Pages (doc_id, filename, source_type, page_number, raw_text) to JSON, a document a line with its pages in order."""
    listed = F.array_sort(F.collect_list(F.struct("page_number", "raw_text")))
    pages.groupBy("doc_id", "filename", "source_type").agg(listed.alias("pages")).write.mode("overwrite").json(path)
