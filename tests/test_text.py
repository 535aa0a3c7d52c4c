import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.functions import text as T


def rows(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", column.alias("x")).orderBy("i").select("x").collect()]


def test_tokens_keep_arabic_marks_and_split_at_half_spaces(spark):
    got = rows(spark, ["چیست؟ خلاصه‌سازی", "كتاب يك", "کِتاب A_1-b", "", None], T.tokens(F.col("t")))
    assert got == [["چیست؟", "خلاصه", "سازی"], ["کتاب", "یک"], ["کتاب", "a_1", "b"], [], []]


def test_stopwords_fall_back(spark):
    got = rows(spark, ["کتاب از این", "از این", "چیست؟"], T.without_stopwords(T.tokens(F.col("t"))))
    assert got == [["کتاب"], ["از", "این"], ["چیست؟"]]


def test_strip_and_words(spark):
    texts = [" \x1c a b \x85　", "", " x\ty"]
    assert rows(spark, texts, T.strip(F.col("t"))) == [t.strip() for t in texts]
    assert rows(spark, texts, T.word_count(F.col("t"))) == [len(t.split()) for t in texts]


def test_cleaning(spark):
    zwnj = T.HALF_SPACE
    assert rows(spark, ["آب\nنان\nکار", "می\nروم", "کتاب\nها", None], T.mend_newlines(F.col("t"))) == ["آب نان\nکار", f"می{zwnj}روم", f"کتاب{zwnj}ها", None]
    assert rows(spark, ["کتابها و تنها", "رها شد، ها"], T.half_space_plural(F.col("t"))) == [f"کتاب{zwnj}ها و تنها", "رها شد، ها"]
    assert rows(spark, ["ﻻ ①"], T.clean(F.col("t"))) == ["لا 1"]


def test_ids_prefix_snippet(spark):
    df = spark.createDataFrame([("a.pdf", 12, "x" * 141, "query: q")], "n string, s long, t string, q string")
    got = df.select(T.document_id(F.col("n"), F.col("s")), T.snippet(F.col("t")), T.with_prefix(F.col("q"), "query"), T.with_prefix(F.col("n"), "passage"), T.with_prefix(F.col("n"), "passage", "bge-m3"), T.chunk_id(F.col("n"), F.lit(1234)), T.chunk_id(F.col("n"), F.lit(7))).first()
    assert re.fullmatch("doc_[0-9a-f]{8}", got[0])
    assert list(got)[1:] == ["x" * 140 + "...", "query: q", "passage: a.pdf", "a.pdf", "a.pdf_c1234", "a.pdf_c007"]


@given(st.lists(st.text(alphabet="aب ِيكک‌A1_،؟-", max_size=30), min_size=1, max_size=30))
@settings(max_examples=8, deadline=None)
def test_tokens_against_python(spark, texts):
    def plain(t):
        t = re.sub("[ً-ْ]", "", t.replace("ي", "ی").replace("ك", "ک")).lower()
        return re.findall("[\\w؀-ۿ]+", t)

    assert rows(spark, texts, T.tokens(F.col("t"))) == [plain(t) for t in texts]
