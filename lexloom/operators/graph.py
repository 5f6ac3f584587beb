"""Relations between meanings: edges (src, rel, dst), at most two hops, first label wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import lookup_key

# fixed values: order in which a relation between two meanings is named
ORDER = ("member", "similar", "hypernym", "hyponym", "sibling", "far", "unknown")


def near(edges: DataFrame) -> DataFrame:
    """(src, dst, label): similar heads and their satellites, hypernyms, hyponyms, siblings; the best label of each pair."""
    e = edges.select("src", "rel", "dst")
    similar = e.filter(F.col("rel").isin("similar", "also"))
    head = e.filter("rel = 'similar'").select(F.col("src").alias("dst"), F.col("dst").alias("other"))
    up = e.filter("rel = 'hypernym'")
    ways = similar.select("src", "dst", F.lit(1).alias("prio"), F.lit("similar").alias("label"))
    ways = ways.union(similar.join(head, "dst").select("src", F.col("other").alias("dst"), F.lit(2), F.lit("similar")))
    ways = ways.union(up.select("src", "dst", F.lit(3), F.lit("hypernym")))
    ways = ways.union(e.filter("rel = 'hyponym'").select("src", "dst", F.lit(4), F.lit("hyponym")))
    shared = up.select(F.col("src").alias("other"), "dst")
    ways = ways.union(up.join(shared, "dst").select("src", F.col("other").alias("dst"), F.lit(5), F.lit("sibling")))
    return ways.filter("src != dst").groupBy("src", "dst").agg(F.min_by("label", "prio").alias("label"))


def antonyms(direct: DataFrame, similar: DataFrame) -> DataFrame:
    """(id, antonym, indirect): direct ones; only where there is none, those of the similar heads."""
    own = direct.select("id", "antonym", F.lit(False).alias("indirect"))
    far = similar.join(direct.select(F.col("id").alias("head"), "antonym"), "head").join(direct.select("id").distinct(), "id", "left_anti")
    return own.union(far.select("id", "antonym", F.lit(True))).distinct()


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names no parent."""
    return rows.join(parents.select(F.col(key).alias(column)), column, "left_anti")


# fixed values: weight of each relation in a meaning's signature
WEIGHTS = {
    "hypernym": 0.7, "hyponym": 0.6, "similar": 0.7, "also": 0.6, "domain_topic": 0.8, "domain_region": 0.6, "has_domain_topic": 0.4,
    "mero_part": 0.6, "holo_part": 0.6, "mero_member": 0.6, "holo_member": 0.6, "mero_substance": 0.6, "holo_substance": 0.6,
    "attribute": 0.5, "entails": 0.5, "is_entailed_by": 0.4, "causes": 0.5, "is_caused_by": 0.4, "derivation": 0.6,
}
#: Order of the parts of speech; a satellite adjective counts as an adjective.
POS_RANK = {"n": 0, "v": 1, "a": 2, "s": 2, "r": 3}


def pos_rank(pos: Column) -> Column:
    out = F.lit(9)
    for p, n in POS_RANK.items():
        out = F.when(pos == p, n).otherwise(out)
    return out


def folded(pos: Column) -> Column:
    return F.when(pos == "s", "a").otherwise(pos)


def members(senses: DataFrame) -> DataFrame:
    """(synset, members): the words of a meaning, ranked ones first, then by spelling."""
    order = F.struct(F.col("member_rank").isNull(), "member_rank", "lemma")
    return senses.groupBy(F.col("synset_id").alias("synset")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["lemma"]).alias("members"))


def related(refs: DataFrame, edges: DataFrame, synsets: DataFrame, senses: DataFrame) -> DataFrame:
    """(src, rel, place, dst, definition, members): the meanings that (src, rel) of ``refs`` lead to, by id."""
    found = refs.select("src", "rel").distinct().join(edges.select("src", "rel", "dst"), ["src", "rel"])
    by = Window.partitionBy("src", "rel").orderBy("dst")
    found = found.withColumn("place", F.row_number().over(by))
    return found.join(synsets.select(F.col("id").alias("dst"), "definition"), "dst").join(members(senses).withColumnRenamed("synset", "dst"), "dst", "left").select("src", "rel", "place", "dst", "definition", "members")


def weighted(edges: DataFrame, sense_edges: DataFrame, senses: DataFrame) -> DataFrame:
    """(src, rel, dst, w): relations that carry weight, and derivations of words lifted to their meanings."""
    ends = senses.select("id", "synset_id")
    a, b = (ends.select(F.col("id").alias(n), F.col("synset_id").alias(s)) for n, s in (("src_sense", "src"), ("dst_sense", "dst")))
    lifted = sense_edges.filter("rel = 'derivation'").join(a, "src_sense").join(b, "dst_sense").filter("src != dst").select("src", "rel", "dst")
    both = edges.filter(F.col("rel").isin(list(WEIGHTS))).select("src", "rel", "dst").union(lifted).distinct()
    weight = F.lit(0.0)
    for rel, w in WEIGHTS.items():
        weight = F.when(F.col("rel") == rel, w).otherwise(weight)
    return both.withColumn("w", weight)


def synsets_of(words: DataFrame, entries: DataFrame, senses: DataFrame) -> DataFrame:
    """(key, pos, place, synset, rank): meanings of (key, pos), in the lexicon's order; without a pos n, v, a, r in turn."""
    own = entries.select(F.col("lemma_key").alias("key"), F.col("id").alias("entry_id"), folded(F.col("pos")).alias("e_pos"), F.col("lemma").alias("e_lemma"))
    found = words.select("key", "pos").distinct().join(own, "key").filter("pos is null or pos = e_pos").join(senses.select("entry_id", "synset_id", "rank"), "entry_id")
    order = [pos_rank(F.col("e_pos")), F.col("e_lemma") != F.col("key"), F.col("entry_id"), F.col("rank")]
    by = Window.partitionBy("key", "pos").orderBy(*order)
    first = found.withColumn("n", F.row_number().over(by)).groupBy("key", "pos", F.col("synset_id").alias("synset")).agg(F.min(F.struct("n", "rank")).alias("m"))
    return first.select("key", "pos", F.row_number().over(Window.partitionBy("key", "pos").orderBy("m.n")).alias("place"), "synset", "m.rank")


def relation(asked: DataFrame, edges: DataFrame, entries: DataFrame, senses: DataFrame) -> DataFrame:
    """(synset, key, pos, label): how a word is linked to a meaning: the closest of ORDER over the word's own meanings.

    A word without a meaning of that part of speech is unknown; one without a link is far.
    """
    ask = asked.select("synset", "key", "pos").distinct()
    names = entries.select(F.col("id").alias("entry_id"), F.col("lemma_key").alias("key"), folded(F.col("pos")).alias("pos"))
    own = senses.select("entry_id", F.col("synset_id").alias("dst")).join(names, "entry_id").select("key", "pos", "dst").distinct()
    # Links lead from a meaning to the words of its neighbours; a word's many meanings are not put beside every question.
    links = near(edges).join(own, "dst").select(F.col("src").alias("synset"), "key", "pos", "label")
    place = F.lit(ORDER.index("far"))
    for i, name in enumerate(ORDER[:5]):
        place = F.when(F.col("label") == name, i).otherwise(place)
    ways = links.select("synset", "key", "pos", place.alias("n")).union(own.select("dst", "key", "pos", F.lit(0)))
    known = own.select("key", "pos").distinct().withColumn("known", F.lit(True))
    ways = ask.join(ways.groupBy("synset", "key", "pos").agg(F.min("n").alias("n")), ["synset", "key", "pos"], "left").join(known, ["key", "pos"], "left")
    n = F.coalesce("n", F.when(F.col("known"), ORDER.index("far")).otherwise(ORDER.index("unknown")))
    return ways.select("synset", "key", "pos", F.get(F.array(*[F.lit(o) for o in ORDER]), n).alias("label"))


def sense_antonyms(refs: DataFrame, senses: DataFrame, sense_edges: DataFrame, edges: DataFrame, synsets: DataFrame, indirect: bool = True) -> DataFrame:
    """(ref, place, sense, lemma, synset, indirect): opposites of a sense, or of all senses of a meaning.

    ``refs`` (ref) are ids of either kind.  Direct ones come in the order of the source senses; only where there is none,
    and if asked for, those of the head adjectives the meaning is similar to follow, by id.
    """
    own = senses.select(F.col("id").alias("sense"), "synset_id", F.col("member_rank").alias("m"))
    ref = refs.select("ref").distinct()
    start = ref.join(own, F.col("ref") == F.col("sense")).select("ref", "sense", "synset_id", F.lit(0).alias("m"))
    start = start.union(ref.join(own, F.col("ref") == F.col("synset_id")).select("ref", "sense", "synset_id", "m"))
    opposite = sense_edges.filter("rel = 'antonym'").select(F.col("src_sense").alias("sense"), "dst_sense")
    direct = start.join(opposite, "sense").groupBy("ref", "dst_sense").agg(F.min(F.struct(F.lit(0).alias("far"), F.col("m"), "sense", F.col("dst_sense").alias("d"))).alias("o"))
    out = direct
    if indirect:
        heads = edges.filter("rel = 'similar'").join(synsets.filter("pos = 'a'").select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("synset_id"), F.col("dst").alias("head"))
        lone = start.select("ref", "synset_id").distinct().join(direct.select("ref"), "ref", "left_anti").hint("merge")
        far = lone.join(heads, "synset_id").join(own.select(F.col("synset_id").alias("head"), "sense"), "head").join(opposite, "sense")
        far = far.groupBy("ref", "dst_sense").agg(F.min(F.struct(F.lit(1).alias("far"), F.lit(0).alias("m"), F.lit("").alias("sense"), F.col("dst_sense").alias("d"))).alias("o"))
        out = direct.union(far)
    out = out.join(senses.select(F.col("id").alias("dst_sense"), "lemma", F.col("synset_id").alias("synset")), "dst_sense")
    place = F.row_number().over(Window.partitionBy("ref").orderBy(F.col("o.far"), F.asc_nulls_first("o.m"), F.col("o.sense"), F.col("dst_sense")))
    return out.select("ref", place.alias("place"), F.col("dst_sense").alias("sense"), "lemma", "synset", (F.col("o.far") == 1).alias("indirect"))


def related_words(asked: DataFrame, edges: DataFrame, senses: DataFrame, entries: DataFrame, unfit: DataFrame, bad: DataFrame, keep: int = 4) -> DataFrame:
    """(synset, lemma, place, word, relation): the first words of narrower, then of broader meanings, for ``asked`` (synset, lemma).

    One word long, fit, not the lemma itself, no name unless the lemma is one; every word once.
    """
    first = senses.filter("member_rank = 1").join(entries.select(F.col("id").alias("entry_id"), "lemma_key"), "entry_id").select(F.col("synset_id").alias("dst"), F.col("lemma").alias("word"), F.col("lemma_key").alias("key"))
    first = first.join(unfit.select(F.col("id").alias("dst")), "dst", "left_anti").join(bad.select("key"), "key", "left_anti").filter(~F.col("key").contains(" "))
    kind = F.when(F.col("rel") == "hyponym", 0).when(F.col("rel") == "hypernym", 1)
    steps = edges.withColumn("kind", kind).filter("kind is not null").select(F.col("src").alias("synset"), "kind", "dst")
    named = F.col("word").rlike(r"^\p{Lu}") & ~F.col("lemma").rlike(r"^\p{Lu}")
    found = asked.select("synset", "lemma").distinct().join(steps, "synset").join(first, "dst").filter((F.col("key") != lookup_key(F.col("lemma"))) & ~named)
    once = found.groupBy("synset", "lemma", "key").agg(F.min(F.struct("kind", "dst", "word")).alias("f"))
    by = Window.partitionBy("synset", "lemma").orderBy("f.kind", "f.dst")
    ranked = once.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= keep)
    return ranked.select("synset", "lemma", "place", "f.word", F.when(F.col("f.kind") == 0, "more specific").otherwise("more general").alias("relation"))
