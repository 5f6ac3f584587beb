"""Word-screen parts: synonyms ranked by agreement of the sources, unfit words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.rules import MAIN_WEIGHT, OTHER_WEIGHT
from lexloom.functions.text import lookup_key
from lexloom.operators import graph, vocabulary
from lexloom.operators import lexicon as lemmatiser
from lexloom.sources.scratch import cut

# fixed values: synonyms, words of a phrase and meanings shown at a level (None: all)
LEVELS = {"junior": (6, 2, 5), "explorer": (10, 4, None)}


def rank_synonyms(rows: DataFrame, familiarity: DataFrame, keep: int, main: str = "base") -> DataFrame:
    """(synset, word, key, source, score) to (synset, key, word, sources, place).

    Sources agree by weight (the main one in full, others by their score); familiar words rank up, long phrases down.
    """
    one = rows.groupBy("synset", "key", "source").agg(F.max("score").alias("score"), F.min_by("word", F.col("word")).alias("word"))
    weight = F.when(F.col("source") == main, MAIN_WEIGHT).otherwise(OTHER_WEIGHT)
    part = weight * F.when(F.col("source") == main, 1.0).otherwise(F.least("score", F.lit(3.0)) / 3.0 + 0.5)
    word = F.min_by("word", F.when(F.col("source") == main, 0).otherwise(1))
    both = one.groupBy("synset", "key").agg(F.sum(part).alias("agree"), word.alias("word"), F.sort_array(F.collect_set("source")).alias("sources"))
    both = both.join(familiarity, "key", "left")
    breaks = F.length("key") - F.length(F.translate("key", " -", ""))
    score = F.col("agree") + 0.6 * F.log1p(F.coalesce("senses", F.lit(0))) - 0.4 * breaks - F.when(F.col("word").rlike(r"^\p{Lu}"), 1.0).otherwise(0.0)
    by = Window.partitionBy("synset").orderBy(F.desc(score), F.length("key"), "key")
    return both.select("synset", "key", "word", "sources", F.row_number().over(by).alias("place")).filter(F.col("place") <= keep)


def bad_words(senses: DataFrame) -> DataFrame:
    """Keys all of whose (key, unfit) senses are unfit."""
    return senses.groupBy("key").agg(F.every("unfit").alias("bad")).filter("bad").select("key")


def require(table: DataFrame | None, name: str) -> DataFrame:
    """A filter table must exist: without it nothing may be shown."""
    if table is None:
        raise ValueError(f"the table {name} is missing")
    return table


def word_screens(picked: DataFrame, meanings: DataFrame, synonyms: DataFrame, antonyms: DataFrame, level: str = "junior") -> DataFrame:
    """One nested record per query: the meanings in picked order with their synonyms and opposites.

    ``picked`` (qid, place, synset, score, clues), ``meanings`` (synset, pos, definition, example), ``synonyms``
    (synset, word, key, place), ``antonyms`` (synset, word).  Unknown levels are an error.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}")
    most, width, shown = LEVELS[level]
    fit = synonyms.filter((F.col("place") <= most) & (F.size(F.split("key", "[ -]")) <= width))
    syn = fit.groupBy("synset").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("synonyms"))
    ant = antonyms.groupBy("synset").agg(F.slice(F.sort_array(F.collect_set("word")), 1, 4).alias("antonyms"))
    rows = picked.join(meanings, "synset").join(syn, "synset", "left").join(ant, "synset", "left")
    none = F.array().cast("array<string>")
    best, second = F.max(F.when(F.col("place") == 1, F.col("score"))), F.max(F.when(F.col("place") == 2, F.col("score")))
    part = F.struct("place", "synset", "pos", "definition", "example", "score", "clues", F.coalesce("synonyms", none).alias("synonyms"), F.coalesce("antonyms", none).alias("antonyms"))
    out = rows.groupBy("qid").agg(F.array_sort(F.collect_list(part)).alias("all"), (best - second).alias("margin"), F.count(F.lit(1)).alias("n"))
    cut = F.slice("all", 1, shown) if shown else F.col("all")
    more = F.greatest(F.col("n") - (shown or 0), F.lit(0)) if shown else F.lit(0).cast("long")
    return out.select("qid", cut.alias("meanings"), "margin", more.alias("more_meanings"))


def screens(asked: DataFrame, lexicon: dict[str, DataFrame], synonyms: DataFrame, unfit: DataFrame, bad: DataFrame, level: str = "junior", picked: DataFrame | None = None, main: str = "base", spellings: tuple[str, str] = ("American spelling", "British spelling")) -> DataFrame:
    """One nested record per question (qid, word): headword, found, meanings, more_meanings, sources.

    Meanings come in the lexicon's order by part of speech; the best of ``picked`` (qid, synset, score, clues, place) comes
    first, however rare it is.  Each has its synonyms (``synonyms``: synset, word, key, source, score), opposites, and, if
    it has few synonyms, related words; unfit meanings and words, and American spellings, are left out.  A word without
    meanings is not found.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}")
    most, width, limit = LEVELS[level]
    us, gb = spellings
    entries, senses = lexicon["entries"], lexicon["senses"]
    own = asked.select("qid", F.trim("word").alias("word"))
    lemmas = cut(lemmatiser.lemmas_in_order(own.select("word"), entries, lexicon["forms"]), "screen-lemmas")
    keyed = lemmas.withColumn("key", lookup_key(F.col("lemma")))
    of = graph.synsets_of(keyed.select("key", "pos"), entries, senses).select("key", "pos", F.col("place").alias("nth"), "synset")
    rows = own.join(keyed, "word").join(of, ["key", "pos"]).join(unfit.select(F.col("id").alias("synset")), "synset", "left_anti")
    rows = rows.groupBy("qid", "synset").agg(F.min(F.struct(graph.pos_rank(F.col("pos")).alias("p"), "place", "nth", "lemma", "pos")).alias("o"))
    chosen = F.lit(None).cast("double")
    if picked is not None:
        rows = rows.join(picked.filter("place = 1").select("qid", "synset", "score", "clues"), ["qid", "synset"], "left")
        chosen = F.col("score")
    else:
        rows = rows.withColumn("clues", F.lit(None).cast("array<string>"))
    by = Window.partitionBy("qid")
    rows = rows.withColumn("fit_score", chosen).withColumn("n", F.count(F.lit(1)).over(by)).withColumn("place", F.row_number().over(by.orderBy(F.col("fit_score").isNull(), "o.p", "o.place", "o.nth")))
    shown = cut((rows.filter(F.col("place") <= limit) if limit else rows).select("qid", "synset", "place", "n", F.col("o.lemma").alias("lemma"), F.col("o.pos").alias("pos"), "fit_score", "clues"), "screen-meanings")
    pairs = shown.select("synset", "lemma").distinct()
    # Synonyms are ranked per meaning and headword, as the headword itself is none.
    both = pairs.join(synonyms, "synset").filter((F.col("key") != lookup_key(F.col("lemma"))) & (F.size(F.split(F.translate("key", "-", " "), " +")) <= width)).join(bad.select("key"), "key", "left_anti")
    both = both.join(vocabulary.american_only(both.select("key"), senses, entries, lexicon["sense_relations"], us, gb), "key", "left_anti")
    familiar = senses.join(entries.select(F.col("id").alias("entry_id"), F.col("lemma_key").alias("key")), "entry_id").groupBy("key").agg(F.count(F.lit(1)).alias("senses"))
    pair = F.concat("synset", F.lit("\u0001"), "lemma")
    ranked = rank_synonyms(both.select(pair.alias("synset"), "word", "key", "source", "score"), familiar, most, main)
    syn = ranked.groupBy(F.col("synset").alias("pair")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word", "sources"))), lambda x: F.struct(x["word"].alias("word"), x["sources"].alias("sources"))).alias("synonyms"))
    refs = pairs.join(senses.select(F.col("synset_id").alias("synset"), "lemma", F.col("id").alias("ref")), ["synset", "lemma"]).hint("merge")
    against = graph.sense_antonyms(refs, senses, lexicon["sense_relations"], lexicon["synset_relations"], lexicon["synsets"]).withColumn("key", lookup_key(F.col("lemma"))).withColumnsRenamed({"lemma": "word", "synset": "a_synset"})
    against = against.join(bad.select("key"), "key", "left_anti").join(unfit.select(F.col("id").alias("a_synset")), "a_synset", "left_anti")
    against = against.groupBy("ref", "key").agg(F.min(F.struct("place", "a_synset", "word")).alias("a")).select("ref", "a.place", F.col("a.a_synset").alias("synset"), "a.word")
    against = against.join(vocabulary.british_forms(against, senses, entries, lexicon["sense_relations"], us, gb), ["synset", "word"]).withColumn("nth", F.row_number().over(Window.partitionBy("ref").orderBy("place"))).filter("nth <= 4")
    ant = against.join(refs.select("ref", pair.alias("pair")), "ref").groupBy("pair").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "form"))), lambda x: x["form"]).alias("antonyms"))
    kin = graph.related_words(pairs, lexicon["synset_relations"], senses, entries, unfit, bad)
    rel = kin.groupBy(pair.alias("pair")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word", "relation"))), lambda x: F.struct(x["word"].alias("word"), x["relation"].alias("relation"))).alias("related"))
    first = lexicon["examples"].groupBy(F.col("synset_id").alias("synset")).agg(F.min_by("text", "seq").alias("example"))
    full = shown.withColumn("pair", pair).join(syn, "pair", "left").join(ant, "pair", "left").join(rel, "pair", "left").join(lexicon["synsets"].select(F.col("id").alias("synset"), "definition"), "synset").join(first, "synset", "left")
    none = F.array().cast("array<string>")
    few = F.coalesce(F.size("synonyms"), F.lit(0)) < 3
    meaning = F.struct("place", "synset", F.col("lemma").alias("word"), "pos", "definition", "example", F.coalesce("synonyms", F.array().cast("array<struct<word:string,sources:array<string>>>")).alias("synonyms"), F.coalesce("antonyms", none).alias("antonyms"), F.when(few, F.col("related")).alias("related"), (F.col("place") > 1).alias("folded"), "fit_score", "clues")
    out = full.groupBy("qid").agg(F.array_sort(F.collect_list(meaning)).alias("meanings"), F.max("n").alias("n"))
    out = own.join(out, "qid", "left")
    used = F.array_distinct(F.flatten(F.transform("meanings", lambda m: F.flatten(F.transform(m["synonyms"], lambda s: s["sources"])))))
    head = F.coalesce(F.col("meanings")[0]["word"], F.col("word"))
    return out.select("qid", "word", head.alias("headword"), F.col("meanings").isNotNull().alias("found"), "meanings", (F.coalesce(F.col("n"), F.lit(0)) - F.coalesce(F.size("meanings"), F.lit(0))).alias("more_meanings"), F.when(F.col("meanings").isNotNull(), F.array_sort(F.array_union(F.array(F.lit(main)), used))).otherwise(none).alias("sources"))


def attributions(screens: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, source, text): what must be said of each source that a screen uses; ``texts`` (source, text)."""
    return screens.select("qid", F.explode("sources").alias("source")).join(texts, "source").select("qid", "source", "text")
