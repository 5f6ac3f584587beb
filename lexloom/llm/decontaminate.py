"""Benchmark decontamination with pigeonhole seeds, in DataFrame operations only.

A pair counts if, in some stretch of ``overlap`` words (or of the whole item, if
shorter), at least ``similarity`` of the words are equal.  With e equal words and d
replaced ones allowed in a stretch, the replaced words leave at most d + 1 runs of
equal words, so the longest has ceil(e / (d + 1)) words at least (4 of 13): a seed is
a mask of that many words, all others ignored, and no tolerated pattern can break all
of its places.  Every token position of every document and test item gives one hash
per length of mask that the items need.  Where hashes are equal, the words around the two places that a stretch
through the seed can reach are compared one by one, each hit by itself: no item
travels, and a passage found everywhere stays spread out.

Up to ``KNOWN_SEEDS`` hashes of test items are looked up where the documents lie, and
only hits go on, with the words around them.  More seeds are broadcast after a check
of their number, or joined by a shuffle, both sides salted; then only hashes travel,
and the hits are joined to their texts.

Tokens are runs of letters and digits, lower-cased.  Defined results: null and empty
texts hold no tokens and are clean; items of a few words must occur whole (up to 4
words no replaced one is tolerated); items without a token mark nothing; equal rows
get equal results; an empty benchmark finds nothing; further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import boxed, materialize, row_key, unboxed

OVERLAP = 13
SIMILARITY = 0.8
#: Seeds of test items that may be looked up in every task, that may be broadcast (about 400 bytes each), and salts of a hash beyond that.
KNOWN_SEEDS, BROADCAST_SEEDS, SALTS = 20_000, 100_000, 16
#: Words of the test items that may be looked up in every task to skip places early; with more, no place is skipped.
VOCABULARY = 20_000


def token_array(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array without any."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ", -1), "")


def run_length(n_words: int, overlap: int = OVERLAP, similarity: float = SIMILARITY) -> int:
    """Words of the run that every tolerated match of an item of ``n_words`` keeps whole."""
    width = min(overlap, n_words)
    equal = next((e for e in range(1, width) if e / width >= similarity), width)
    return -(-equal // (width - equal + 1))


def frames(overlap: int = OVERLAP, similarity: float = SIMILARITY) -> dict[int, int]:
    """Per length of run the widest stretch that is looked for with it."""
    out: dict[int, int] = {}
    for n in range(1, overlap + 1):
        run = run_length(n, overlap, similarity)
        out[run] = max(out.get(run, 0), n)
    return out


def _around(tokens: Column, place: Column, run: int, width: int) -> Column:
    """The words that a stretch of ``width`` through the run at ``place`` can hold; null beyond the text."""
    return F.array(*[F.get(tokens, place + o) for o in range(run - width, width)])


def seeds(rows: DataFrame, runs: dict[int, int], vocabulary: list[str] | None = None, known: list[int] | None = None) -> DataFrame:
    """``rows`` (with tokens) and the column seeds, array<struct<pos, run, h>>: one hash per length of run and place.

    With a vocabulary, places are skipped where a token of the shortest run is not in it; with known hashes, all others.
    """
    none = F.array().cast("array<int>")
    shortest = min(runs)
    tokens = F.col("tokens")

    def places(length):
        last = F.size(tokens) - F.lit(length)
        return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(none)

    def hashed(run):
        return lambda i: F.struct(i.alias("pos"), F.lit(run).alias("run"), F.xxhash64(F.lit(run), *[F.get(tokens, i + o) for o in range(run)]).alias("h"))

    def told(found):
        def test(i):
            out = F.get(found, i)
            for o in range(1, shortest):
                out = out & F.get(found, i + o)
            return out

        return test

    if vocabulary is None:
        out = rows.withColumn("seeds", F.concat(*[F.transform(places(run), hashed(run)) for run in runs]))
    else:
        # Tokens are letters and digits only, so they may stand in the text of an expression.
        listed = ", ".join(f"'{w}'" for w in vocabulary) or "''"
        found = F.expr(f"transform(tokens, w -> w IN ({listed}))")
        # An array of one binds its element to a name, so that it is worked out once.
        starts = F.flatten(F.transform(F.array(found), lambda f: F.filter(places(shortest), told(f))))
        fits = lambda run: lambda i: i + run <= F.size(tokens)
        hashes = lambda own: F.concat(*[F.transform(F.filter(own, fits(run)), hashed(run)) for run in runs])
        out = rows.withColumn("seeds", F.flatten(F.transform(F.array(starts), hashes)))
    if known is None:
        return out
    listed = ", ".join(f"{h}L" if h > -(2**63) else "cast('-9223372036854775808' as bigint)" for h in known) or "null"
    return out.withColumn("seeds", F.expr(f"filter(seeds, s -> s.h IN ({listed}))"))


def _around_seed(tokens: Column, runs: dict[int, int], pos: Column, run: Column) -> Column:
    out = None
    for r, width in runs.items():
        out = (F if out is None else out).when(run == r, _around(tokens, pos, r, width))
    return out


def _most_equal(own: Column, item: Column, width: Column) -> Column:
    """Most equal words in a stretch of ``width`` that lies inside the item, of two surroundings of one seed."""
    equal = F.zip_with(own, item, lambda a, b: F.when(a == b, 1).otherwise(0))
    starts = F.sequence(F.lit(1), F.size(item) - width + 1)
    inside = lambda s: F.get(item, s - 1).isNotNull() & F.get(item, s + width - 2).isNotNull()
    held = lambda e: lambda s: F.when(inside(s), F.aggregate(F.slice(e, s, width), F.lit(0), lambda a, x: a + x)).otherwise(0)
    return F.array_max(F.flatten(F.transform(F.array(equal), lambda e: F.transform(starts, held(e)))))


def overlaps(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, similarity: float = SIMILARITY) -> DataFrame:
    """Per document row: doc_id, k, n_hits (equal seeds looked at), items (verified item ids), best (share of equal words)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), token_array(F.col("text")).alias("item")).filter(F.size("item") > 0).distinct()
    lengths = [run_length(n, overlap, similarity) for n in range(1, overlap + 1)]
    run_of = F.get(F.array(*[F.lit(n) for n in lengths]), F.least(F.size("item"), F.lit(overlap)) - 1)
    widest = frames(overlap, similarity)
    used = sorted(r[0] for r in items.select(run_of).distinct().collect()) or [max(lengths)]
    runs = {r: widest[r] for r in used}
    own_seeds = seeds(items.withColumnRenamed("item", "tokens"), runs).withColumnRenamed("tokens", "item")
    own_seeds = own_seeds.select("item_id", "item", F.explode(F.filter("seeds", lambda s: s["run"] == run_of)).alias("s"))
    own_seeds = own_seeds.select("item_id", F.least(F.lit(overlap), F.size("item")).alias("width"), F.col("s.h").alias("h"), _around_seed(F.col("item"), runs, F.col("s.pos"), F.col("s.run")).alias("item"))
    item_seeds = materialize(own_seeds, "item-seeds")
    n_seeds = item_seeds.count()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("k"), "text")
    tokens = own.select("doc_id", "k", token_array(F.col("text")).alias("tokens"))
    words = [r[0] for r in items.select(F.explode("item")).distinct().limit(VOCABULARY + 1).collect()]
    vocabulary = sorted(words) if len(words) <= VOCABULARY else None
    if n_seeds <= KNOWN_SEEDS:
        known = sorted(r[0] for r in item_seeds.select("h").distinct().collect())
        at = lambda s: F.struct(s["h"].alias("h"), _around_seed(F.col("tokens"), runs, s["pos"], s["run"]).alias("own"))
        # No filter on seeds: pushed below, it would put the splitting of the text inside the lambdas, once a place.
        found = seeds(tokens, runs, vocabulary, known).select("doc_id", "k", F.explode(F.transform("seeds", at)).alias("s"))
        hits = found.select("doc_id", "k", F.col("s.h").alias("h"), F.col("s.own").alias("own")).join(F.broadcast(item_seeds), "h")
    else:
        places = seeds(tokens, runs, vocabulary).select("doc_id", "k", F.explode("seeds").alias("s")).select("doc_id", "k", "s.pos", "s.run", "s.h")
        if n_seeds <= BROADCAST_SEEDS:
            hits = places.join(F.broadcast(item_seeds), "h")
        else:
            salted = item_seeds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            hits = places.withColumn("salt", F.pmod(F.xxhash64("k", "pos"), F.lit(SALTS))).join(salted, ["h", "salt"])
        texts = tokens.select(F.col("doc_id").alias("t_id"), F.col("k").alias("t_key"), "tokens").dropDuplicates(["t_id", "t_key"])
        hits = hits.join(texts, (F.col("k") == F.col("t_key")) & F.col("doc_id").eqNullSafe(F.col("t_id")))
        hits = hits.withColumn("own", _around_seed(F.col("tokens"), runs, F.col("pos"), F.col("run")))
    hits = hits.select("doc_id", "k", "item_id", (_most_equal(F.col("own"), F.col("item"), F.col("width")) / F.col("width")).alias("share"))
    by_item = hits.groupBy("doc_id", "k", "item_id").agg(F.max("share").alias("share"), F.count(F.lit(1)).alias("n"))
    good = F.when(F.col("share") >= similarity, F.struct("item_id"))
    per_doc = by_item.groupBy(F.col("doc_id").alias("h_id"), F.col("k").alias("h_key")).agg(F.sum("n").alias("n_hits"), F.array_sort(F.collect_list(good)).alias("found"), F.max("share").alias("best"))
    keys = own.select("doc_id", "k")
    joined = keys.join(per_doc, (F.col("k") == F.col("h_key")) & F.col("doc_id").eqNullSafe(F.col("h_id")), "left")
    return joined.select(
        "doc_id",
        "k",
        F.coalesce("n_hits", F.lit(0).cast("long")).alias("n_hits"),
        F.coalesce(F.transform("found", lambda x: x["item_id"]), F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("best", F.lit(0.0)).alias("best"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without those that overlap a test item."""
    bad = overlaps(docs, benchmark, **options).filter(F.size("items") > 0).select("doc_id", "k").distinct()
    same = (F.col("own.k") == F.col("bad.k")) & F.col("own.id").eqNullSafe(F.col("bad.doc_id"))
    return unboxed(boxed(docs).alias("own").join(bad.alias("bad"), same, "left_anti"))
