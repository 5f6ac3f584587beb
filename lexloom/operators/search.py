"""Completion and near spelling over a vocabulary of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import lookup_key, sound_key


def completions(queries: DataFrame, vocabulary: DataFrame, keep: int = 8) -> DataFrame:
    """(query, key, place): keys that begin with the query, shortest first; an empty query has none.

    Joined on the first letters of the query, three at most.
    """
    q = queries.select("query").distinct().filter("query != ''").withColumn("block", F.left("query", F.lit(3)))
    heads = F.array_distinct(F.array(*[F.left("key", F.lit(n)) for n in (1, 2, 3)]))
    v = vocabulary.select("key").distinct().select("key", F.explode(heads).alias("block"))
    found = q.join(v, "block").filter(F.col("key").startswith(F.col("query")))
    by = Window.partitionBy("query").orderBy(F.length("key"), "key")
    return found.select("query", "key", F.row_number().over(by).alias("place")).filter(F.col("place") <= keep)


def _deletions(word, most):
    """Explodes to the words left when up to ``most`` (0, 1 or 2) letters go, besides the word itself."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, F.length(w))))
    first = F.when(F.length(word) > 0, one(word)).otherwise(F.array().cast("array<string>"))
    second = F.flatten(F.transform(F.filter(first, lambda w: F.length(w) > 0), one))
    return F.array_distinct(F.concat(F.array(word), F.when(most >= 1, first).otherwise(F.array().cast("array<string>")), F.when(most >= 2, second).otherwise(F.array().cast("array<string>"))))


#: Letters of a query that may differ in two places at most, and tasks among which keys of one first letter and length are dealt.
FEW_LETTERS, SHARES = 8, 32


def suggestions(queries: DataFrame, vocabulary: DataFrame, keep: int = 5) -> DataFrame:
    """(query, key, place): keys of the same sound, then keys with the same first letter, near length and few edits.

    Two words within one or two edits share a word that deletions make of both, so those are joined on, and only pairs
    that share one are measured.  Longer queries (nine letters and more) may differ in three places and more; their
    pairs are those of the same first letter and near length.
    """
    q = queries.select("query").distinct().filter("query != ''")
    v = vocabulary.select("key").distinct()
    distance = F.levenshtein("query", "key")
    alike = q.withColumn("sound", sound_key(F.col("query"))).join(v.withColumn("sound", sound_key(F.col("key"))), "sound").filter("sound != ''")
    alike = alike.select("query", "key", F.lit(0).alias("kind"), distance.alias("d"), F.length("key").alias("n"))
    most = F.greatest(F.lit(1), F.floor(F.length("query") / 3))
    few, many = q.filter(most <= 2), q.filter(most > 2)
    head = lambda c: F.left(c, F.lit(1)).alias("head")
    # The longest of these queries has eight letters: longer keys than ten are none of theirs, and have many deletions.
    short = v.filter(F.length("key") <= FEW_LETTERS + 2)
    by_cut = few.select("query", head("query"), F.explode(_deletions(F.col("query"), most)).alias("cut")).join(short.select("key", head("key"), F.explode(_deletions(F.col("key"), F.lit(2))).alias("cut")), ["head", "cut"])
    by_cut = by_cut.select("query", "key").filter(F.abs(F.length("query") - F.length("key")) <= 2).distinct()
    lengths = F.explode(F.sequence(F.length("query") - 2, F.length("query") + 2)).alias("n")
    # There are few first letters and lengths: the keys of one are dealt to SHARES tasks, its queries go to all of them.
    every = many.select("query", head("query"), lengths).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    dealt = v.filter(F.length("key") > FEW_LETTERS - 2).select("key", head("key"), F.length("key").alias("n"), F.pmod(F.xxhash64("key"), F.lit(SHARES)).cast("int").alias("share"))
    by_length = every.join(dealt, ["head", "n", "share"]).select("query", "key")
    near = by_cut.union(by_length).withColumns({"most": most, "d": F.levenshtein("query", "key")})
    near = near.filter("d <= most").select("query", "key", F.lit(1).alias("kind"), "d", F.lit(0).alias("n"))
    ways = alike.union(near).filter("key != query").groupBy("query", "key").agg(F.min(F.struct("kind", "d", "n")).alias("rank"))
    by = Window.partitionBy("query").orderBy("rank.kind", "rank.d", "rank.n", "key")
    return ways.select("query", "key", F.row_number().over(by).alias("place")).filter(F.col("place") <= keep)


def look_up(words: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(word, key, found, meanings, said): the entry of a word: its number of meanings and its pronunciation, by serving tables."""
    own = words.select("word").distinct().withColumn("key", lookup_key(F.col("word")))
    n = tables["entry"].groupBy("key").agg(F.count(F.lit(1)).alias("meanings"))
    out = own.join(n, "key", "left").join(tables["ipa"].select("key", F.col("ipa").alias("said")), "key", "left")
    return out.select("word", "key", F.col("meanings").isNotNull().alias("found"), F.coalesce("meanings", F.lit(0)).alias("meanings"), "said")


def results(queries: DataFrame, vocabulary: DataFrame, keep_completions: int = 8, keep_suggestions: int = 5) -> DataFrame:
    """(query, key, kind, place): the exact key, or suggestions without one, then completions; every key once."""
    q, v = queries.select("query").distinct(), vocabulary.select("key").distinct()
    exact = q.join(v, F.col("query") == F.col("key")).select("query", "key", F.lit("exact").alias("kind"), F.lit(0).alias("part"), F.lit(1).alias("n"))
    near = suggestions(q.join(exact.select("query"), "query", "left_anti"), v, keep_suggestions).select("query", "key", F.lit("suggestion").alias("kind"), F.lit(1).alias("part"), F.col("place").alias("n"))
    more = completions(q, v, keep_completions).select("query", "key", F.lit("completion").alias("kind"), F.lit(2).alias("part"), F.col("place").alias("n"))
    first = exact.union(near).union(more).groupBy("query", "key").agg(F.min(F.struct("part", "n", "kind")).alias("r"))
    by = Window.partitionBy("query").orderBy("r.part", "r.n")
    return first.select("query", "key", "r.kind", F.row_number().over(by).alias("place"))
