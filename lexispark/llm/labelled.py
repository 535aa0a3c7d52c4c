"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc32_of_id


def held_out(id_column: str = "doc_id"):
    return F.pmod(crc32_of_id(id_column), F.lit(5)) == 0


def training_texts(
    docs: DataFrame, labels: DataFrame, label: str, most_of_class: dict[int, int], id_column: str = "doc_id", text_column: str = "text", most_bytes: int = 32 << 20
) -> list[tuple[str, int]]:
    """Whole texts and labels of at most ``most_of_class`` rows of each class, chosen by a hash of their id; never a held-out row.

    Taken in that hash's order, the sample ends with the row that brings it to ``most_bytes``, which is read whole like all others: so
    long texts are as likely to be in it as short ones. The chosen ids (a fixed number at most) are broadcast; the texts come one after another.
    """
    usable = labels.where(~held_out(id_column)).where(F.col(label).isin(*most_of_class)).where(F.col(id_column).isNotNull())
    chosen = None
    for value, most in most_of_class.items():
        of_class = usable.where(F.col(label) == value).groupBy(id_column).agg(F.first(label).alias("y")).orderBy(F.xxhash64(id_column), id_column).limit(most)
        chosen = of_class if chosen is None else chosen.unionByName(of_class)
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    texts = docs.select(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")).alias("text")).join(F.broadcast(chosen), id_column)
    sizes = texts.groupBy(id_column, F.xxhash64(id_column).alias("place")).agg(F.sum(F.octet_length("text")).alias("size")).collect()
    total, kept = 0, []
    for row in sorted(sizes, key=lambda r: (r.place, r[id_column])):
        if total >= most_bytes:
            break
        total += row.size
        kept.append(row[id_column])
    if len(kept) < len(sizes):
        texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in kept], texts.select(id_column).schema)), id_column, "left_semi")
    return sorted(((r.text, int(r.y)) for r in texts.select("text", "y").toLocalIterator()), key=lambda r: r)
