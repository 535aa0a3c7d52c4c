"""Mixing sources to target weights by entropy balancing, in DataFrame and SQL functions only.

Each source has a token target. Document rates minimise the relative entropy to
keeping every document once, under the constraint that a source's rates times sizes
sum to its target and that no rate exceeds ``cap``. The optimum is an exponential tilt,
``rate = min(cap, exp(lambda * size / scale))`` with one multiplier a source, and the
multipliers minimise a convex dual. Newton iterations find them: each is one
distributed aggregation of gradient and curvature over the (source, size) histogram,
kept inside a bracket that shrinks, so it converges from anywhere. State stays in
tables; the driver sees one number an iteration, the largest relative error.

Rates become copies without randomness: within a source, sizes go from large to
small and each size's copies are rounded with the error, in tokens, carried on to the next smaller
size, so a source ends within about half its smallest document of its target unless the
cap binds. Among documents of one size the extra copies go by a hash of doc_id, counted in
pieces of ``piece_rows``, and the join that tells each row its size's plan never deals by size alone, so one size that
holds a third of all rows is many tasks.

A source's sizes are folded in one row: as many entries as there are different
sizes, at most the words of its longest document, however many documents there are.

Cases: a null text has size 0 and rate 1. Null is a source of its own, last in order.
Rows with the same doc_id count one by one. Sources without words have target 0.
Texts of any length are counted whole. An empty table gives no rows. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, documents, materialize

WORD = r"[^\x20\x09-\x0D]+"
KEY = ["source_key", "no_source"]


def sizes_of(df: DataFrame, id_column: str, source_column: str, text_column: str) -> DataFrame:
    return df.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(source_column), F.lit("")).alias("source_key"),
        F.col(source_column).isNull().alias("no_source"),
        F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(id_column, text_column).alias("mix"),
    )


def targets_of(sources: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    """Adds ``target``: the level at which weight times level, stopped at cap times source_size, sums to all sizes.

    One row per source; the level is found where, in order of cap over weight, the capped ones end.
    """
    ordered = Window.orderBy("no_source", "source_key")
    listed = sources.withColumn("i", F.row_number().over(ordered) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("i", F.lit(len(weights))) + 1))
    most = F.col("source_size") * cap
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(most / F.col("weight"), "i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0))) / F.sum("weight").over(onwards)
    # With the first i sources capped, the level rises with i while those are rightly capped and falls after that.
    highest = F.max("level").over(everything)
    return listed.withColumn("level", level).withColumn("target", F.least(most.cast("double"), highest * F.col("weight"))).select(*KEY, "source_size", "target")


def tilt(cap: int):
    return F.when(F.col("full"), F.lit(float(cap))).when(F.col("target") <= 0, F.when(F.col("size") == 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("multiplier") * F.col("size") / F.col("scale"))))


def balance(histogram: DataFrame, sources: DataFrame, cap: int, *, tolerance: float = 1e-7, most_steps: int = 60) -> tuple[DataFrame, list[str]]:
    """Newton iterations on the dual; returns the sources with their multipliers, and the folders that hold them.

    Each step narrows the interval that a multiplier lies in. Where ``most_steps`` don't settle all of them, twice as many halve the interval each time;
    multipliers that are off even then are an error.
    """
    state = sources.withColumns({
        "full": F.col("target") >= F.col("source_size") * cap * (1 - 1e-12), "multiplier": F.lit(0.0), "lo": -60 * F.col("scale"), "hi": F.log(F.lit(float(cap))) * F.col("scale") + 1, "error": F.lit(1.0),
    })
    state, folder = materialize(state, "balance")
    columns = state.columns
    for taken in range(0, 3 * most_steps, 2):
        nxt = state
        for _ in range(2):
            rated = histogram.join(nxt, KEY).withColumn("rate", tilt(cap))
            tokens = F.col("n").cast("double") * F.col("size") * F.col("rate")
            inner = F.col("rate") < cap
            sums = rated.groupBy(*KEY).agg(F.sum(tokens).alias("got"), F.sum(F.when(inner, tokens * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"), *(F.first(c).alias(c) for c in columns if c not in KEY))
            excess = F.col("got") - F.col("target")
            settled = F.col("full") | (F.col("target") <= 0)
            step = sums.withColumn("lo", F.when(excess < 0, F.col("multiplier")).otherwise(F.col("lo"))).withColumn("hi", F.when(excess > 0, F.col("multiplier")).otherwise(F.col("hi")))
            newton = F.col("multiplier") - F.try_divide(excess, F.col("slope"))
            inside = (newton > F.col("lo")) & (newton < F.col("hi")) & F.lit(taken < most_steps)
            step = step.withColumn("error", F.when(settled, 0.0).otherwise(F.abs(F.try_divide(excess, F.col("target"))))).withColumn(
                "multiplier", F.when(settled | (F.col("error") <= tolerance), F.col("multiplier")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
            )
            nxt = step.select(*columns)
        state, newer = materialize(nxt, "balance")
        discard(histogram.sparkSession, folder)
        folder = newer
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst <= tolerance:
            return state, [folder]
    raise RuntimeError(f"multipliers are off by {worst:.1e} of a target after {3 * most_steps} steps")


#: Over ``cells`` (size, n, rate), large sizes first: copies a size, with the rounding error in tokens carried on.
#: Blocks of 1,024 cells are folded on their own, so that what is there already isn't copied for every cell.
_ROUNDED = """
aggregate(transform(sequence(0, (size(cells) - 1) div 1024), b -> slice(cells, 1024 * b + 1, 1024)),
  named_struct('carry', 0D, 'out', cast(array() as array<struct<size: bigint, n: bigint, copies: bigint>>)),
  (all, block) -> aggregate(block, named_struct('carry', all.carry, 'out', cast(array() as array<struct<size: bigint, n: bigint, copies: bigint>>)),
    (s, x) -> named_struct(
      'carry', if(x.size = 0, s.carry, s.carry + x.n * x.rate * x.size - x.size * greatest(0L, least({cap} * x.n, cast(round(x.n * x.rate + s.carry / x.size) as bigint)))),
      'out', concat(s.out, array(named_struct('size', x.size, 'n', x.n, 'copies',
         if(x.size = 0, x.n, greatest(0L, least({cap} * x.n, cast(round(x.n * x.rate + s.carry / x.size) as bigint)))))))),
    s -> named_struct('carry', s.carry, 'out', concat(all.out, s.out))),
  all -> all.out)"""
#: Bytes of a plan that every task may hold, and rows of one size that meet a larger plan in one task.
HELD, DEALT = 16 << 20, 1 << 20


def with_plan(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row with its source's and size's plan. A plan of ``HELD`` bytes is broadcast, after they were
    counted; a larger one is joined on a key that deals the rows of one size over as many tasks as they need.
    """
    found = plan.agg(F.sum(F.octet_length("source_key") + 112).alias("held"), F.max("n").alias("n")).first()
    keys = [*KEY, "size"]
    if (found.held or 0) <= HELD:
        return sizes.join(F.broadcast(plan), keys)
    deals = -(-found.n // DEALT)
    every = plan.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    return sizes.withColumn("deal", F.pmod(F.xxhash64("mix"), F.lit(deals)).cast("int")).join(every, [*keys, "deal"]).drop("deal")


def mix_sources(df: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", piece_rows: int = 512) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, rate, copies, taken (copies times size), mix (hash of id and text)."""
    spark = df.sparkSession
    sizes, _ = materialize(sizes_of(df, id_column, source_column, text_column), "sizes")
    histogram, _ = materialize(sizes.groupBy(*KEY, "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    totals = histogram.groupBy(*KEY).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.col("n").cast("double") * F.col("size") * F.col("size")).alias("squares"))
    scales = totals.select(*KEY, F.coalesce(F.try_divide(F.col("squares"), F.col("source_size")), F.lit(1.0)).alias("scale"))
    scales = scales.withColumn("scale", F.greatest("scale", F.lit(1.0)))
    sources = targets_of(totals.select(*KEY, "source_size"), weights, cap).join(scales, KEY)
    state, _ = balance(histogram, sources, cap)
    rated = histogram.join(state, KEY).withColumn("rate", tilt(cap))
    cells = rated.groupBy(*KEY, "source_size", "target").agg(F.sort_array(F.collect_list(F.struct("size", "n", "rate")), asc=False).alias("cells"))
    copies = cells.select(*KEY, "source_size", "target", F.explode(F.expr(_ROUNDED.format(cap=cap))).alias("c")).select(*KEY, "source_size", "target", "c.*")
    rates = rated.select(*KEY, "size", "rate", F.ceil(F.col("n") / piece_rows).alias("n_salts"))
    plan, _ = materialize(copies.join(rates, [*KEY, "size"]), "copies")
    placed = with_plan(sizes, plan).withColumn("salt", F.pmod("mix", "n_salts"))
    piece = [*KEY, "size", "salt"]
    counts = placed.groupBy(*piece).agg(F.count(F.lit(1)).alias("in_piece"))
    before = Window.partitionBy(*KEY, "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*piece, F.coalesce(F.sum("in_piece").over(before), F.lit(0)).alias("first"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy(*piece).orderBy("mix", F.asc_nulls_first("doc_id"))) - 1).join(counts, piece)
    own = F.expr("copies div n") + F.when(F.col("first") + F.col("rank") < F.expr("copies % n"), 1).otherwise(0)
    out = ranked.withColumn("own", own)
    return out.select("doc_id", F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "size", "source_size", "target", "rate", F.col("own").alias("copies"), (F.col("own") * F.col("size")).alias("taken"), "mix")


def repeat_to_mix(df: DataFrame, *, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them. Rows that repeat doc_id and text appear as often as they take together."""
    mixed = mix_sources(df, id_column=id_column, source_column=source_column, text_column=text_column, **options)
    times = mixed.groupBy(F.col("doc_id").alias("mix_id"), F.col("mix").alias("mix_key")).agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    # All columns travel in one struct, so their names can't clash with these.
    keyed = df.select(F.col(id_column).alias("key_id"), F.xxhash64(id_column, text_column).alias("key"), F.struct("*").alias("row"))
    both = keyed.join(times, F.col("key_id").eqNullSafe(F.col("mix_id")) & (F.col("key") == F.col("mix_key")))
    once = both.groupBy("key_id", "key").agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")
