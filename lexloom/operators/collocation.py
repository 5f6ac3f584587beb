"""Runs of words that a sentence shares with an example, through the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: least length of a run, points for every word beyond two
LEAST_RUN, PER_WORD = 3, 3.0


def collocations(sentences: DataFrame, targets: DataFrame, examples: DataFrame) -> DataFrame:
    """(qid, synset, run, bonus): the longest shared run through the target that holds another content word.

    ``sentences`` (qid, j, key, is_stop), ``targets`` (qid, ti, synset), ``examples`` (synset, ex, i, key).  Equal words
    lie on a diagonal i - j; a run is an unbroken stretch of one diagonal.
    """
    asked = targets.select("qid", "synset", "ti")
    pairs = sentences.join(asked, "qid").join(examples, ["synset", "key"]).withColumn("diagonal", F.col("i") - F.col("j"))
    line = ["qid", "synset", "ex", "diagonal"]
    pairs = pairs.withColumn("island", F.col("j") - F.row_number().over(Window.partitionBy(*line).orderBy("j")))
    other = F.when((F.col("j") != F.col("ti")) & ~F.col("is_stop"), 1).otherwise(0)
    runs = pairs.groupBy(*line, "island").agg(F.count(F.lit(1)).alias("run"), F.max(F.when(F.col("j") == F.col("ti"), 1).otherwise(0)).alias("on"), F.max(other).alias("content"))
    best = runs.filter((F.col("run") >= LEAST_RUN) & (F.col("on") == 1) & (F.col("content") == 1)).groupBy("qid", "synset").agg(F.max("run").alias("run"))
    return best.select("qid", "synset", "run", (F.lit(PER_WORD) * (F.col("run") - 2)).alias("bonus"))
