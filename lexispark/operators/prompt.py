"""Citations, context blocks, messages and answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.text import snippet, strip

# Texts of prompts and answers.
SYSTEM = """تو یک دستیار هوشمند، متعهد و امانت‌دار برای پاسخ‌گویی به سوالات بر اساس اسناد شخصی کاربر هستی.

وظیفه تو این است که فقط و فقط بر اساس «زمینه‌ها و اسناد مرجع» ارائه‌شده در پیام کاربر پاسخ دهی.
حتماً قوانین زیر را بدون استثنا رعایت کن:
۱. فقط از حقایق و اطلاعات موجود در متون ارائه‌شده استفاده کن. هرگز از دانسته‌های قبلی خود چیزی را حدس نزن یا اضافه نکن.
۲. اگر پاسخ سوال به صراحت در اسناد ذکر نشده است یا اسناد برای پاسخ ناکافی هستند، صراحتاً بگو: «پاسخی برای این پرسش در اسناد بارگذاری‌شده شما یافت نشد.» و هیچ اطلاعات ساختگی ارائه نده.
۳. در انتهای هر ادعا یا پاسخ، حتماً نام سند و شماره صفحه منبع را ذکر کن (مثال: [سند: قرارداد.pdf، صفحه: ۳]).
۴. پاسخ باید خلاصه، مستند، منسجم، روان و کاملاً به زبان فارسی باشد."""
FALLBACK = "پاسخی برای این پرسش در اسناد بارگذاری‌شده شما یافت نشد."
UNKNOWN = "نامشخص"
HEADER = "[منبع شماره {i} | سند: {doc} | شماره صفحه: {page}]"
SEPARATOR = "\n\n---\n\n"
ONLY_QUESTION = "پرسش کاربر:\n{question}"
WITH_CONTEXT = "بر اساس «زمینه‌ها و اسناد مرجع» زیر، به پرسش مطرح‌شده با ذکر دقیق شماره صفحه پاسخ بده.\n\n### زمینه‌ها و اسناد مرجع:\n{context}\n\n### پرسش کاربر:\n{question}"
ERROR = "⚠️ خطا در تولید پاسخ با مدل زبانی: {error}"
MOCK_REPLY = "بر اساس اسناد ارائه‌شده (صفحه {page}):\n{text}"


def filled(template: str, **values: Column) -> Column:
    """A template with its {names} replaced by columns."""
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def known_document(doc_id: Column, meta_doc_id: Column) -> Column:
    return F.coalesce(F.nullif(doc_id, F.lit("")), meta_doc_id, F.lit(UNKNOWN))


def known_page(page: Column, meta_page: Column) -> Column:
    return F.coalesce(F.nullif(page, F.lit(0)), meta_page, F.lit(0))


def citation_columns() -> list[Column]:
    """Over text, doc_id, page_number, similarity, score."""
    return [
        F.col("doc_id"), F.col("doc_id").alias("filename"), F.col("page_number"),
        rounded(F.coalesce("similarity", "score", F.lit(0.0)), 3).alias("score"), snippet(F.coalesce("text", F.lit(""))).alias("snippet"),
    ]


def context_block(chunks: Column) -> Column:
    """An array of structs (text, doc_id, page_number), in order, to one text."""
    blocks = F.transform(chunks, lambda c, i: F.concat(filled(HEADER, i=i + 1, doc=known_document(c["doc_id"], F.lit(None)), page=known_page(c["page_number"], F.lit(None))), F.lit("\n"), strip(c["text"])))
    return F.array_join(blocks, SEPARATOR)


def user_message(question: Column, context: Column) -> Column:
    asked = strip(question)
    return F.when(strip(context) == "", filled(ONLY_QUESTION, question=asked)).otherwise(filled(WITH_CONTEXT, context=context, question=asked))


def history_tail(messages: DataFrame, turns: int = 3, *, chat: str = "chat_id", order: str = "id") -> DataFrame:
    """The last 2 * turns messages of each chat that are a user's or an assistant's and not empty, stripped.

    0 turns mean no limit and negative ones count as 0, which keeps a caller's existing results.
    """
    valid = messages.where(F.col("role").isin("user", "assistant") & (F.col("content") != ""))
    if turns > 0:
        last = F.row_number().over(Window.partitionBy(chat).orderBy(F.desc(order)))
        valid = valid.withColumn("from_end", last).where(F.col("from_end") <= 2 * turns).drop("from_end")
    return valid.withColumn("content", strip(F.col("content")))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(history: Column, user: Column, system: str = SYSTEM) -> Column:
    return F.concat(F.array(message("system", F.lit(system))), history, F.array(message("user", user)))


def chatml(listed: Column) -> Column:
    parts = F.transform(listed, lambda m: F.concat(F.lit("<|im_start|>"), F.coalesce(m["role"], F.lit("user")), F.lit("\n"), strip(F.coalesce(m["content"], F.lit(""))), F.lit("<|im_end|>")))
    return F.array_join(F.concat(parts, F.array(F.lit("<|im_start|>assistant\n"))), "\n")


def mock_answer(text: Column, page: Column) -> Column:
    return filled(MOCK_REPLY, page=F.coalesce(page, F.lit(1)), text=strip(F.coalesce(text, F.lit(""))))


def answer_tokens(answers: DataFrame, key: str, column: str = "answer") -> DataFrame:
    """key, position, token: pieces between single spaces, each with a space behind it; empty pieces stay."""
    return answers.select(key, F.posexplode(F.split(column, " ")).alias("position", "piece")).select(key, "position", F.concat("piece", F.lit(" ")).alias("token"))


def joined_answer(tokens: DataFrame, key: str) -> DataFrame:
    """The text that a token stream makes, stripped."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "token")))
    return tokens.groupBy(key).agg(strip(F.array_join(F.transform(ordered, lambda x: x["token"]), "")).alias("answer"))
