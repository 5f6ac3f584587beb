"""Mixing sources to target weights: floor(rate) copies plus one hash-seeded Bernoulli copy.

Native DataFrame operations only.  Tokens are summed per source (a partial
aggregate, so a hot source costs one row per task), target totals are filled up
like water in vessels: every source gets words in proportion to its weight, a
source stops at ``cap`` times its own size, and the excess is shared out again
by weight.  The fixed point of that rule has a closed form (vessels fill in the
order of cap / weight), which two running sums over the per-source table give.

Defined results: null texts have size 0; a null source is a source of its own,
ordered last; sources without any word have target 0 and rate 0; equal rows draw
the same number, since the draw depends only on seed, doc_id and (for null ids)
the text; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import WORD, boxed, materialize

#: A per-source table of at most so many rows is broadcast; beyond it the join is salted instead.
BROADCAST_SOURCES = 50_000
SALTS = 64


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on seed and document alone."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth + 1).cast("int"))
    vessels = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("top"))
    vessels = vessels.withColumn("level", F.col("top") / F.col("w"))
    fill = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    want = F.sum("source_size").over(whole) * F.lit(float(share))
    vessels = vessels.withColumn("reach", (want - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # The first vessel that the water does not fill fixes the level of all that stay open.
    height = F.min(F.when(F.col("reach") <= F.col("level"), F.struct("level", F.col("source").isNull(), "source", "reach"))).over(whole)
    vessels = vessels.withColumn("height", height["reach"])
    return vessels.select("source", "source_size", F.when(F.col("height").isNull(), F.col("top")).otherwise(F.least("top", F.col("height") * F.col("w"))).alias("target"))


def _planned(docs: DataFrame, weights: tuple[int, ...], share: float, cap: float, seed: str) -> DataFrame:
    """``docs`` with the struct column ``mix_plan``: size, source_size, target, rate, copies."""
    sizes = docs.select("source", token_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, cap), "mix-targets")
    t = targets.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_total"), F.col("target").alias("mix_target"))
    own = docs.withColumn("mix_size", token_count(F.col("text")))
    same = F.col("source").eqNullSafe(F.col("mix_source"))
    if targets.count() <= BROADCAST_SOURCES:
        joined = own.join(F.broadcast(t), same)
    else:
        own = own.withColumn("mix_salt", F.pmod(F.xxhash64("doc_id", "mix_size"), F.lit(SALTS)))
        t = t.withColumn("mix_salts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = own.join(t, same & (F.col("mix_salt") == F.col("mix_salts")))
    rate = F.when(F.col("mix_total") > 0, F.col("mix_target") / F.col("mix_total")).otherwise(F.lit(0.0))
    draw = uniform(seed, F.col("doc_id"), F.col("text"))
    copies = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    plan = F.struct(F.col("mix_size").alias("size"), F.col("mix_total").alias("source_size"), F.col("mix_target").alias("target"), rate.alias("rate"), copies.alias("copies"))
    return joined.select(*docs.columns, plan.alias("mix_plan"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """Per document row: doc_id, source, size, source_size, target, rate, copies, taken."""
    planned = _planned(docs.select("doc_id", "source", "text"), weights, share, cap, seed)
    return planned.select("doc_id", "source", "mix_plan.*").withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """The mixed corpus itself: the rows of ``docs``, each as often as its plan says, with a ``copy`` number from 1.

    A column of ``docs`` named copy comes out as copy_input.
    """
    named = docs.withColumnRenamed("copy", "copy_input") if "copy" in docs.columns else docs
    own = boxed(named).select("row", "row.doc_id", "row.source", "row.text")
    planned = _planned(own, weights, share, cap, seed).filter("mix_plan.copies > 0")
    return planned.select("row.*", F.explode(F.sequence(F.lit(1), F.col("mix_plan.copies").cast("int"))).alias("copy"))
