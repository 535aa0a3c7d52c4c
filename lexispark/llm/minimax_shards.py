"""Minimax contiguous sharding, in DataFrame and SQL functions only.

Groups of equal texts stay together and stand in the order of a 64-bit hash of the
text. They are first summed in 65,536 cells, the hash's top 16 bits, so the ordered list
of sizes that is cut has a proven length at any scale. A binary search finds the smallest
capacity for which a greedy sweep over that list needs no more than ``n_shards`` shards.
Where a cell of several groups could hold a cut, it is split into 256 smaller ones by the next
bits, and the search runs again between the bounds that are left; after six rounds at most no such cell is left,
and the capacity is the least for the groups themselves. Each round splits a few cells around each of the
``n_shards - 1`` cuts, whatever the input. Cuts keep to the capacity, each as near to an
even share of what is left as the capacity allows for the rest.

Slots are gapless: rows are numbered inside (shard, cell, salt) pieces of about
``piece_rows`` rows, and pieces follow one another inside a shard, so neither a
shard nor a large group of copies is ever one task.

Cases: a null text counts as the empty text; null and empty texts are one group.
Rows with equal ids and texts get slots of their own. An empty table gives no rows.
A group larger than an even share makes the capacity at least its size. Texts of any length count whole. Other
columns may have any name. One law holds: ``bytes``; ``grown_shard`` is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, materialize

#: Over ``a`` (cells in order: cell, bytes) and ``k`` shards. All folds run inside one row of all cells.
_CAPACITY = """
aggregate(sequence(1, 64),
  named_struct('lo', least(greatest(least_capacity, cast(ceil(total / k) as bigint)), cast(ceil(total / k) as bigint) + largest), 'hi', cast(ceil(total / k) as bigint) + largest),
  (s, i) -> if(s.lo >= s.hi, s,
    if(s.lo + (s.hi - s.lo) div 2 >= largest and aggregate(a, named_struct('n', 1, 'cur', 0L),
         (g, x) -> if(g.cur + x.bytes <= s.lo + (s.hi - s.lo) div 2, named_struct('n', g.n, 'cur', g.cur + x.bytes), named_struct('n', g.n + 1, 'cur', x.bytes))).n <= k,
       named_struct('lo', s.lo, 'hi', s.lo + (s.hi - s.lo) div 2),
       named_struct('lo', s.lo + (s.hi - s.lo) div 2 + 1, 'hi', s.hi))),
  s -> s.lo)"""
#: Bytes before each cut of the greedy sweep with a capacity.
_SWEPT = """
aggregate(a, named_struct('cur', 0L, 'before', 0L, 'cuts', cast(array() as array<bigint>)),
  (s, x) -> if(s.before > 0 and s.cur + x.bytes > least_capacity,
               named_struct('cur', x.bytes, 'before', s.before + x.bytes, 'cuts', if(size(s.cuts) < k - 1, concat(s.cuts, array(s.before)), s.cuts)),
               named_struct('cur', s.cur + x.bytes, 'before', s.before + x.bytes, 'cuts', s.cuts)),
  s -> s.cuts)"""
#: First cell of each shard when shards are filled from the end: the least place at which the rest still fits.
_FROM_END = """
aggregate(reverse(a), named_struct('cur', 0L, 'cell', 0L, 'starts', cast(array() as array<bigint>)),
  (s, x) -> if(s.cur + x.bytes <= capacity, named_struct('cur', s.cur + x.bytes, 'cell', x.cell, 'starts', s.starts),
               named_struct('cur', x.bytes, 'cell', x.cell, 'starts', concat(s.starts, array(s.cell)))),
  s -> s.starts)"""
_CUTS = """
aggregate(a, named_struct('cur', 0L, 'before', 0L, 'cuts', cast(array() as array<bigint>)),
  (s, x) -> if(s.before > 0 and (s.cur + x.bytes > capacity
                 or (size(s.cuts) + 1 < k and x.cell >= coalesce(get(least_starts, k - size(s.cuts) - 2), x.cell)
                     and 2 * s.cur + x.bytes > 2 * ((total - s.before + s.cur) / (k - size(s.cuts))))),
               named_struct('cur', x.bytes, 'before', s.before + x.bytes, 'cuts', concat(s.cuts, array(x.cell))),
               named_struct('cur', s.cur + x.bytes, 'before', s.before + x.bytes, 'cuts', s.cuts)),
  s -> s.cuts)"""


def _one(cells: DataFrame, n_shards: int, least_capacity: int) -> DataFrame:
    one = cells.agg(F.array_sort(F.collect_list(F.struct(F.col("cell").cast("long").alias("cell"), "bytes"))).alias("a"), F.sum("bytes").alias("total"), F.max("bytes").alias("largest"))
    return one.where("total is not null").withColumn("k", F.lit(n_shards)).withColumn("least_capacity", F.lit(least_capacity).cast("long"))


def least_capacity_of(cells: DataFrame, n_shards: int, at_least: int = 0) -> int:
    found = _one(cells, n_shards, at_least).select(F.expr(_CAPACITY)).collect()
    return found[0][0] if found else 0


def cuts_within(cells: DataFrame, n_shards: int, capacity: int) -> list[int]:
    """The first cell of every shard but the first.

    Each fold is a query of its own, with what came before as literals: merged into
    one, Spark would run the search anew for every cell.
    """
    one = _one(cells, n_shards, 0).withColumn("capacity", F.lit(capacity).cast("long"))
    starts = one.select(F.expr(_FROM_END)).collect()
    if not starts:
        return []
    one = one.withColumn("least_starts", F.array(*map(F.lit, starts[0][0])).cast("array<bigint>"))
    return one.select(F.expr(_CUTS)).first()[0]


def plan_cuts(cells: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """The least capacity, and the first cell of every shard but the first. ``cells``: cell, bytes."""
    capacity = least_capacity_of(cells, n_shards)
    return capacity, cuts_within(cells, n_shards, capacity)


def _start(width: int) -> Column:
    """The smallest key of the range of 2^width keys that a row's key is in."""
    return F.shiftleft(F.shiftright("text_key", width), width)


def _summed(rows: DataFrame, width: int) -> DataFrame:
    """cell, width, bytes, n, and whether the cell holds more than one group."""
    several = F.min("text_key") != F.max("text_key")
    return rows.groupBy(_start(width).alias("cell")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), several.alias("several")).withColumn("width", F.lit(width))


def plan_groups(rows: DataFrame, n_shards: int, *, top: int = 48, step: int = 8) -> tuple[int, list[int], DataFrame]:
    """The least capacity for the groups of ``rows`` (text_key, size), the first key of every shard but the first, and the first cells.

    With a capacity from lo to hi, greedy cut i lies between where a sweep over whole cells with lo puts it
    and i * hi bytes. Only cells that reach into such a range matter; rounding the best plan's cuts down to cells adds
    to a shard less than one of them, which gives lo.
    """
    whole, _ = materialize(_summed(rows, top), "minimax-cells")
    cells, lo, ranges = whole, 0, None
    ordered = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        hi = least_capacity_of(cells, n_shards, lo)
        placed = cells.withColumn("before", F.coalesce(F.sum("bytes").over(ordered), F.lit(0)))
        inside = lambda r: (F.col("before") < r["hi"]) & (F.col("before") + F.col("bytes") > r["lo"])
        largest = placed.where("several").where(F.lit(True) if ranges is None else F.exists(ranges, inside)).agg(F.max("bytes")).first()[0] or 0
        lo = max(lo, hi - largest)
        swept = _one(cells, n_shards, lo).select(F.expr(_SWEPT)).collect()
        if not largest or not swept or not swept[0][0]:
            break
        ranges = F.array(*(F.struct(F.lit(cut).cast("long").alias("lo"), F.lit((i + 1) * hi).cast("long").alias("hi")) for i, cut in enumerate(swept[0][0])))
        wide, _ = materialize(placed.where("several").where(F.exists(ranges, inside)).select("cell", "width"), "minimax-wide")
        widths = [r.width for r in wide.select("width").distinct().collect()]
        if not widths:
            break
        finer = cells.join(F.broadcast(wide), ["cell", "width"], "left_anti").select("cell", "bytes", "n", "several", "width")
        for width in widths:
            of_width = F.broadcast(wide.where(F.col("width") == width).select(F.col("cell").alias("wide")))
            finer = finer.unionByName(_summed(rows.withColumn("wide", _start(width)).join(of_width, "wide", "left_semi"), max(0, width - step)))
        cells, _ = materialize(finer, "minimax-cells")
    return hi, cuts_within(cells, n_shards, hi), whole


def shard_minimax(df: DataFrame, n_shards: int = 24, *, id_column: str = "doc_id", text_column: str = "text", piece_rows: int = 512) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = df.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    rows, _ = materialize(rows, "minimax-rows")
    _, cuts, cells = plan_groups(rows, n_shards)
    shard = sum(((F.col("text_key") >= c).cast("int") for c in cuts), F.lit(0))
    # At most 65,536 rows of two numbers, whatever the input.
    salts = F.broadcast(cells.select("cell", F.ceil(F.col("n") / piece_rows).alias("n_salts")))
    placed = rows.withColumn("cell", _start(48)).join(salts, "cell").withColumn("salt", F.pmod(F.xxhash64("doc_id"), "n_salts").cast("int")).withColumn("shard", shard).drop("n_salts")
    piece = ["shard", "cell", "salt"]
    pieces = placed.groupBy(*piece).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*piece, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*piece).orderBy("text_key", F.asc_nulls_first("doc_id")))
    numbered = placed.withColumn("rank", rank).join(pieces, piece)
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_minimax(documents(spark, sf_dir), 24)
