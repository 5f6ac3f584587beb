"""Figures of an evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import wilson


def accuracy(hits: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """(by, n, k, low, high): share of hits with its Wilson interval."""
    out = hits.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("long")).alias("k"))
    return out.select(*by, "n", "k", wilson(F.col("k").cast("double"), F.col("n").cast("double")).alias("w")).select(*by, "n", "k", "w.low", "w.high")


def exclusive_quantile(values: DataFrame, by: list[str], column: str, q: int, parts: int = 10) -> DataFrame:
    """(by, value): q-th of ``parts`` cut points by the exclusive method, at rank q (n + 1) / parts, interpolated.

    Equal values are counted first, so a group's window runs over its distinct values, not its rows.
    """
    counted = values.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    ranked = counted.withColumn("upto", F.sum("c").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = F.col("n") + 1
    low = F.least(F.greatest(F.floor(at * q / parts), F.lit(1)), F.col("n") - 1).cast("long")
    ranked = ranked.withColumn("j", low).withColumn("delta", F.col("n") * q + q - low * parts)
    holds = lambda r: F.when((F.col("upto") >= r) & (F.col("upto") - F.col("c") < r), F.col("x"))
    two = ranked.groupBy(*by).agg(F.max(holds(F.col("j"))).alias("a"), F.max(holds(F.col("j") + 1)).alias("b"), F.max("delta").alias("delta"))
    return two.select(*by, ((F.col("a") * (parts - F.col("delta")) + F.col("b") * F.col("delta")) / parts).alias("value"))


def summary(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, n, mean, median, p90, top): the figures of a latency report."""
    plain = values.filter(F.col(column).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.max(column).alias("top"))
    for name, q, parts in (("median", 1, 2), ("p90", 9, 10)):
        plain = plain.join(exclusive_quantile(values, by, column, q, parts).withColumnRenamed("value", name), by)
    return plain.select(*by, "n", "mean", "median", "p90", "top")


def unseen(items: DataFrame, seen: DataFrame, column: str = "word") -> DataFrame:
    """The rows of ``items`` whose word no row of ``seen`` has."""
    return items.join(seen.select(column).distinct(), column, "left_anti")


def gold_rank(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, gold_place, top1, top3): the best place of a right meaning; (qid, place, synset) against (qid, synset), several may be right."""
    items = gold.select("qid").distinct()
    hit = predictions.join(gold, ["qid", "synset"]).groupBy("qid").agg(F.min("place").alias("gold_place"))
    out = items.join(hit, "qid", "left")
    return out.withColumns({"top1": F.coalesce(F.col("gold_place") == 1, F.lit(False)), "top3": F.coalesce(F.col("gold_place") <= 3, F.lit(False))})


def first_sense(items: DataFrame, entry: DataFrame, with_pos: bool = True) -> DataFrame:
    """Baseline predictions (qid, place, synset): the commonest sense of (qid, key, pos)."""
    on = ["key", "pos"] if with_pos else ["key"]
    ranked = items.select("qid", *on).join(entry, on)
    by = Window.partitionBy("qid").orderBy("rank", "synset")
    return ranked.select("qid", F.row_number().over(by).alias("place"), "synset").filter("place = 1")


def failures(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, said, right): items whose first prediction is wrong or missing, with all right meanings in order."""
    right = gold.groupBy("qid").agg(F.array_sort(F.collect_set("synset")).alias("right"))
    first = predictions.filter("place = 1").select("qid", F.col("synset").alias("said"))
    return right.join(first, "qid", "left").filter(F.col("said").isNull() | ~F.array_contains("right", F.col("said"))).select("qid", "said", "right")
