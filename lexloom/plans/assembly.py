"""The integrated lexicon: groups of two old books aligned to meanings, and everything put together.

Every step works on all groups at once.  Groups that cannot be aligned, and words that are held back, are tables of their
own, with the reason, for an audit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import lookup_key
from lexloom.operators import align, graph, vocabulary
from lexloom.operators import lexicon as lemmatiser
from lexloom.sources.scratch import cut

# fixed values: parts of speech of the books that the lexicon has, and labels that make a group or word unfit
BOOK_POS = {"n": "n", "v": "v", "adj": "a", "adv": "r"}
UNFIT_SENSES = ("vulgar", "low", "cant", "cant term", "cant word", "in contempt", "in derision")
UNFIT_WORDS = ("vulgar", "derogatory", "slang")


@dataclass(frozen=True)
class Base:
    """What alignment needs of a lexicon: its tables, the stop list, the words around each meaning, and unfit words."""

    lexicon: dict[str, DataFrame]
    stop: DataFrame
    hood: DataFrame
    bad: DataFrame
    blocked: Column | None = None


def base(lexicon: dict[str, DataFrame], stop: DataFrame, definitions: DataFrame, bad: DataFrame, blocked: Column | None = None) -> Base:
    """``definitions`` (synset, key) are lemma keys; ``blocked`` is a condition on the column key."""
    members = lexicon["senses"].select(F.col("synset_id").alias("synset"), lookup_key(F.col("lemma")).alias("key")).distinct()
    return Base(lexicon, stop, cut(align.neighbourhood(members, definitions, lexicon["synset_relations"], stop), "hood"), bad, blocked)


def book_pos(pos: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, code in BOOK_POS.items():
        out = F.when(pos == name, code).otherwise(out)
    return out


def _keys(b: Base, words: DataFrame) -> DataFrame:
    """(word, key): lemma keys of all words of ``words`` (key) and of their parts."""
    parts = words.select(F.explode(F.array_union(F.array("key"), F.split("key", "[ -]+"))).alias("word")).filter("word != ''").distinct()
    return lemmatiser.word_keys(parts, b.lexicon["entries"], b.lexicon["forms"]).select("word", "key")


def _clean(b: Base, words: DataFrame) -> DataFrame:
    """(word, clean): the usable ones of (word)."""
    entries, senses = b.lexicon["entries"], b.lexicon["senses"]
    known = entries.select(F.col("lemma_key").alias("key")).distinct()
    parts = words.select(F.explode(F.split(lookup_key(F.col("word")), "[ -]+")).alias("word")).filter("word != ''").distinct()
    forms = lemmatiser.lemmas_in_order(parts, entries, b.lexicon["forms"]).select(F.col("word").alias("form")).distinct()
    done = vocabulary.clean(words, known, vocabulary.canonical_forms(senses, entries), forms, b.bad, b.blocked)
    return done.filter("clean is not null").select("word", "clean")


def _scored(b: Base, heads: DataFrame, words: DataFrame, usable: DataFrame | None = None) -> DataFrame:
    """Verdicts of ``heads`` (group, head, pos) by ``words`` (group, role, key)."""
    found = graph.synsets_of(heads.select(F.col("head").alias("key"), "pos"), b.lexicon["entries"], b.lexicon["senses"])
    found = found.select(F.col("key").alias("head"), "pos", F.col("synset").alias("target"), F.col("place").alias("ord"))
    return cut(align.best_meanings(heads, words, found, b.hood, _keys(b, words.select("key").distinct()), b.stop, usable), "verdicts")


def _synonyms(b: Base, aligned: DataFrame, usable: DataFrame) -> DataFrame:
    """(group, synset, word, pos, score): usable words that fit the part of speech of the meaning of their group."""
    pos = b.lexicon["synsets"].select(F.col("id").alias("target"), graph.folded(F.col("pos")).alias("pos"))
    rows = aligned.join(usable, "group").join(pos, "target").withColumn("key", lookup_key(F.col("clean")))
    fits = vocabulary.fits_pos(rows.select("key", "pos"), b.lexicon["entries"]).filter("fits").select("key", "pos")
    return rows.join(fits, ["key", "pos"], "left_semi").select("group", F.col("target").alias("synset"), F.col("clean").alias("word"), "pos", "score")


def align_synonyms(b: Base, records: DataFrame, source: str) -> dict[str, DataFrame]:
    """Senses of a book of synonyms: tables synonyms, alignments and unaligned.

    ``records`` (headword, pos, senses, line) as the source gives them.  A sense with an unfit label, or without a usable
    word besides the headword, says nothing; unsupported parts of speech go to the audit.
    """
    sense = records.select("headword", "pos", "line", F.explode("senses").alias("s")).filter(F.size("s.synonyms") > 0)
    ref = F.concat(F.col("line").cast("string"), F.lit("#"), F.col("s.n").cast("string"))
    own = sense.select(F.concat(ref, F.lit("|"), F.coalesce("pos", F.lit(""))).alias("group"), ref.alias("ref"), "headword", "pos", lookup_key(F.col("headword")).alias("head"), F.col("s.synonyms").alias("words"), F.col("s.labels").alias("labels"))
    own = cut(own, "sense-groups")
    supported = F.col("pos").isNull() | F.col("pos").isin(list(BOOK_POS))
    odd = own.filter(~supported).select("group", "ref", "headword", "pos", "words", F.lit("unsupported_pos").alias("reason"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("score"))
    fit = own.filter(supported & ~F.exists(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.rtrim(F.lower(x), F.lit(".")).isin(list(UNFIT_SENSES))))
    said = fit.select("group", "head", F.explode("words").alias("word")).distinct()
    usable = said.join(_clean(b, said.select("word").distinct()), "word").filter(lookup_key(F.col("clean")) != F.col("head")).select("group", "clean").distinct()
    usable = cut(usable, "usable")
    counted = usable.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    heads = fit.join(counted, "group", "left_semi").select("group", "head", book_pos(F.col("pos")).alias("pos"))
    words = said.join(counted, "group", "left_semi").select("group", F.lit("group").alias("role"), lookup_key(F.col("word")).alias("key")).distinct()
    done = _scored(b, heads, words).join(own.select("group", "ref", "headword", F.col("pos").alias("book_pos"), "words"), "group").join(counted, "group", "left")
    aligned = done.filter("verdict = 'aligned'")
    synonyms = _synonyms(b, aligned.select("group", "target", "score"), usable).join(own.select("group", "ref"), "group")
    missed = done.filter("verdict != 'aligned'").select("group", "ref", "headword", F.col("book_pos").alias("pos"), "words", F.col("verdict").alias("reason"), F.col("target").alias("best"), "score")
    return {
        "synonyms": synonyms.select("synset", "word", F.lit(source).alias("source"), "score", "ref"),
        "alignments": aligned.select(F.lit(source).alias("source"), "ref", "headword", F.col("target").alias("synset"), "score", "second", F.col("n").alias("n_words")),
        "unaligned": missed.union(odd).select(F.lit(source).alias("source"), "ref", "headword", "pos", "words", "reason", "best", "score"),
    }


def align_heads(b: Base, records: DataFrame, source: str) -> dict[str, DataFrame]:
    """Word groups of a thesaurus of heads, each of its words in turn as the headword: tables synonyms, alignments, unaligned, withheld.

    ``records`` (head, name, groups) as the source gives them.  The other groups of the paragraph, and the words of the
    head's name, help a little.  Aligned words become synonyms if the lexicon links them closely or does not know them.
    """
    rows = records.select("head", "name", F.posexplode("groups").alias("gi", "g"))
    listed = F.coalesce(F.col("g.unrecognised"), F.array().cast("array<string>"))
    rows = cut(rows.select("head", "name", "gi", F.concat("head", F.lit(":"), F.col("gi").cast("string")).alias("ref"), F.col("g.pos").alias("book_pos"), book_pos(F.col("g.pos")).alias("pos"), F.col("g.para").alias("para"), F.col("g.label").alias("label"), F.col("g.words").alias("words"), listed.alias("extra"), F.col("g.labels").alias("labels")), "head-groups")
    known = b.lexicon["entries"].select(F.col("lemma_key").alias("key"), graph.folded(F.col("pos")).alias("pos")).distinct()
    extra = rows.select("ref", "pos", F.explode("extra").alias("word")).withColumn("key", lookup_key(F.col("word"))).join(known, ["key", "pos"], "left_semi").select("ref", "word")
    bad_labels = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x).isin(list(UNFIT_WORDS)))
    said = rows.select("ref", F.explode("words").alias("word")).union(extra).distinct().join(rows.select("ref", "labels"), "ref")
    said = said.filter(~bad_labels(F.try_element_at("labels", "word"))).select("ref", "word")
    said = cut(said.join(said.groupBy("ref").count().filter("count >= 2"), "ref", "left_semi"), "group-words")
    clean = said.join(_clean(b, said.select("word").distinct()), "word").select("ref", "clean").distinct()
    group = lambda: F.concat("ref", F.lit("|"), "word")
    heads = said.select(group().alias("group"), "ref", "word", lookup_key(F.col("word")).alias("head")).join(rows.select("ref", "book_pos", "pos", "label", "words"), "ref")
    usable = heads.select("group", "ref", "head").join(clean, "ref").filter(lookup_key(F.col("clean")) != F.col("head")).select("group", "clean").distinct()
    usable = cut(usable, "usable")
    counted = usable.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    heads = cut(heads.join(counted, "group"), "heads")
    # A group is compared once per headword, but its words are the same: they are joined by group, not repeated before.
    others = rows.select(F.col("ref").alias("ref"), "head", "book_pos", "para").join(rows.select(F.col("ref").alias("o_ref"), "head", "book_pos", "para", F.explode("words").alias("word")), ["head", "book_pos", "para"]).filter("ref != o_ref").select("ref", F.lit("context").alias("role"), "word").distinct()
    others = others.join(said, ["ref", "word"], "left_anti").select("ref", "role", "word")
    named = rows.select(F.col("ref").alias("id"), F.col("name").alias("text"))
    name_keys = lemmatiser.content_lemma_keys(named, lemmatiser.word_keys(lemmatiser.text_words(named), b.lexicon["entries"], b.lexicon["forms"]), b.stop).select(F.col("id").alias("ref"), F.lit("name").alias("role"), F.col("key").alias("word"))
    around = said.select("ref", F.lit("group").alias("role"), "word").union(others).union(name_keys)
    words = heads.select("group", "ref").join(around, "ref").select("group", "role", lookup_key(F.col("word")).alias("key")).distinct()
    supported = heads.filter("pos is not null")
    done = _scored(b, supported.select("group", "head", "pos"), words, counted).join(heads.select("group", "ref", "word", "book_pos", "words", "label", "n"), "group")
    aligned = done.filter("verdict = 'aligned'")
    fit = _synonyms(b, aligned.select("group", "target", "score"), usable).withColumn("key", lookup_key(F.col("word")))
    label = graph.relation(fit.select("synset", "key", "pos"), b.lexicon["synset_relations"], b.lexicon["entries"], b.lexicon["senses"]).withColumnRenamed("label", "relation")
    linked = fit.join(label, ["synset", "key", "pos"]).join(aligned.select("group", "ref", "label"), "group")
    kept = align.keeps(linked)
    why = F.when(F.col("relation") == "unknown", "unknown_in_list").otherwise(F.col("relation"))
    odd = heads.filter("pos is null").select("ref", "word", "book_pos", "words", F.lit("unsupported_pos").alias("reason"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("score"))
    missed = done.filter("verdict != 'aligned'").select("ref", "word", "book_pos", "words", F.col("verdict").alias("reason"), F.col("target").alias("best"), "score")
    return {
        "synonyms": kept.filter("kept").select("synset", "word", F.lit(source).alias("source"), "score", "ref"),
        "alignments": aligned.select(F.lit(source).alias("source"), "ref", F.col("word").alias("headword"), F.col("target").alias("synset"), "score", "second", F.col("n").alias("n_words")),
        "unaligned": missed.union(odd).select(F.lit(source).alias("source"), "ref", F.col("word").alias("headword"), F.col("book_pos").alias("pos"), "words", "reason", "best", "score"),
        "withheld": kept.filter("not kept").select("synset", "word", "key", F.lit(source).alias("source"), "ref", why.alias("relation")),
    }


def assemble(b: Base, unfit: DataFrame, blocked: DataFrame, books: list[DataFrame], main: str) -> dict[str, DataFrame]:
    """sense_synonyms (synset, word, key, source, score) and kid_filter (kind, key, reason).

    The lexicon's own members count 1, each key once, by rank; of the books the best score per (synset, key, source)
    counts; neither for ``unfit`` (id, reason) meanings, nor members that are ``blocked`` (key).
    """
    own = b.lexicon["senses"].select(F.col("synset_id").alias("synset"), "lemma", lookup_key(F.col("lemma")).alias("key"), "member_rank")
    first = own.groupBy("synset", "key").agg(F.min_by("lemma", F.struct(F.col("member_rank").isNull(), "member_rank", "lemma")).alias("word"))
    rows = first.join(blocked.select("key"), "key", "left_anti").select("synset", "word", "key", F.lit(main).alias("source"), F.lit(1.0).alias("score"))
    for book in books:
        best = F.max_by(F.struct("word", "score"), F.struct("score", F.col("word"))).alias("r")
        more = book.withColumn("key", lookup_key(F.col("word"))).groupBy("synset", "key", "source").agg(best)
        rows = rows.union(more.select("synset", "r.word", "key", "source", "r.score"))
    synonyms = rows.join(unfit.select(F.col("id").alias("synset")), "synset", "left_anti")
    words = blocked.select(F.lit("word").alias("kind"), "key", F.lit("blocklist").alias("reason"))
    more = b.bad.select("key").join(blocked.select("key"), "key", "left_anti").select(F.lit("word"), "key", F.lit("offensive"))
    return {"sense_synonyms": synonyms.select("synset", "word", "key", "source", "score"), "kid_filter": unfit.select(F.lit("synset").alias("kind"), F.col("id").alias("key"), "reason").union(words).union(more).distinct()}
