"""Text functions as column expressions. Lengths and offsets are code points. Arrow UDFs stand in only where Spark has no builtin."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The words that lexical search leaves out.
STOPWORDS = (
    "در به از که با و یا این آن را برای تا است شد بود می یک رو بر چه چیست کجا کی چرا چگونه کدام شدن بودن کردن دارد دارند ها های"
).split()
# Letters of the newline and plural rules, beginnings and endings that a half space joins, whole words that only look like plurals.
LETTERS = "ءآأؤإئابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیيك"
PREFIXES = ("می", "نمی", "بی")
SUFFIXES = ("ها", "تر", "ترین")
NOT_PLURAL = ("تنها", "رها", "بها", "شاها", "آنچنانها")
HALF_SPACE = "‌"

#: What counts as white space where text is stripped or split into words.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
TOKEN = r"[\p{L}\p{N}_\x{0600}-\x{06FF}]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column) -> Column:
    """Lexical tokens: Arabic yeh and kaf unified, vowel marks dropped, small letters. Null and empty texts have none."""
    unified = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "يك", "یک"), r"[\x{064B}-\x{0652}]", "")
    return F.regexp_extract_all(F.lower(unified), F.lit(TOKEN), F.lit(0))


def without_stopwords(words: Column, stopwords: list[str] | None = None) -> Column:
    """Drops stop words, unless nothing would be left."""
    listed = STOPWORDS if stopwords is None else stopwords
    # A set that Spark looks words up in, not a list that it goes through for each.
    left = F.filter(words, lambda w: ~w.isin(listed))
    return F.when(F.size(left) == 0, words).otherwise(left)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))


def with_prefix(text: Column, kind: str, model_key: str = "e5-small") -> Column:
    """Embedding models of the e5 family want ``query: `` or ``passage: `` in front, once."""
    if "e5" not in model_key:
        return text
    return F.when(text.startswith(f"{kind}: "), text).otherwise(F.concat(F.lit(f"{kind}: "), text))


def snippet(text: Column, most: int = 140) -> Column:
    return strip(F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text))


def document_id(name: Column, size: Column) -> Column:
    """From name and size alone: files that share both share the id."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws("_", name, size.cast("string")), 256), 1, 8))


def chunk_id(doc_id: Column, index: Column) -> Column:
    """Three digits at least, more where the index needs them."""
    digits = index.cast("string")
    return F.concat(doc_id.cast("string"), F.lit("_c"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


_BROKEN = re.compile(f"([{LETTERS}]+)\n([{LETTERS}]+)")


def _mend(m: re.Match) -> str:
    joint = HALF_SPACE if m[1] in PREFIXES or m[2] in SUFFIXES else " "
    return m[1] + joint + m[2]


@F.pandas_udf(StringType())
def mend_newlines(texts: pd.Series) -> pd.Series:
    """One pass from left to right: a word that one joint used up doesn't take part in the next."""
    return texts.map(lambda t: _BROKEN.sub(_mend, t), na_action="ignore")


def half_space_plural(text: Column) -> Column:
    """A half space before the plural ending, except in whole words that merely end like it."""
    words = "|".join(NOT_PLURAL)
    boundary = r"(?![\p{L}\p{N}_])"
    return F.regexp_replace(text, rf"(?<![{LETTERS}])(?!(?:{words}){boundary})([{LETTERS}]+)ها{boundary}", f"$1{HALF_SPACE}ها")


def _only(rule, text: Column, pattern: str) -> Column:
    """The rule where the pattern is found; all other texts don't leave the JVM."""
    return F.coalesce(rule(F.when(text.rlike(pattern), text)), text)


def clean(text: Column, normalise=None) -> Column:
    """NFKC, mended newlines, an optional language normaliser (a column function), half spaces."""
    composed = _only(nfkc, text, r"[^\x00-\x7F]")
    mended = _only(mend_newlines, composed, f"[{LETTERS}]\n[{LETTERS}]")
    normal = normalise(mended) if normalise else mended
    return F.when(normal.contains("ها"), half_space_plural(normal)).otherwise(normal)
