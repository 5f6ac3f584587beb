"""What may be shown: unfit meanings and words, usable words of old books, spellings of one side of the ocean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import british_variants, lookup_key, word_shape
from lexloom.operators.graph import folded

# fixed values: words that join a phrase and carry no meaning of their own
FUNCTION_WORDS = (
    "a an the of to in on at by for from with without into onto out up down off over under upon about after before through and or as one "
    "one's oneself self be is not no any some all its it his her their them him what that this away back again"
).split()
#: Words of a phrase at most.
LONGEST_PHRASE = 4


def unfit_meanings(domains: list[str], slang_origin: str, synsets: DataFrame, senses: DataFrame, sense_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, reason): meanings that exemplify, or one of whose senses does, a usage named in ``domains``; and slang by origin."""
    named = senses.filter(lookup_key(F.col("lemma")).isin(domains)).select(F.col("synset_id").alias("dst")).distinct()
    whole = edges.filter("rel = 'exemplifies'").join(named, "dst", "left_semi").select(F.col("src").alias("id"))
    ends = senses.select("id", "synset_id")
    one = sense_edges.filter("rel = 'exemplifies'").join(ends.select(F.col("id").alias("dst_sense"), F.col("synset_id").alias("dst")), "dst_sense").join(named, "dst", "left_semi")
    one = one.join(ends.select(F.col("id").alias("src_sense"), F.col("synset_id").alias("s")), "src_sense").select(F.col("s").alias("id"))
    slang = synsets.filter(F.col("origin") == slang_origin).select("id", F.lit("modern_slang").alias("reason"))
    both = whole.union(one).select("id", F.lit("offensive").alias("reason")).union(slang)
    return both.groupBy("id").agg(F.max("reason").alias("reason"))  # offensive comes after modern_slang


def unfit_words(senses: DataFrame, entries: DataFrame, unfit: DataFrame) -> DataFrame:
    """(key): words all of whose meanings are unfit."""
    own = senses.join(entries.select(F.col("id").alias("entry_id"), F.col("lemma_key").alias("key")), "entry_id")
    own = own.join(unfit.select(F.col("id").alias("synset_id"), F.lit(True).alias("bad")).distinct(), "synset_id", "left")
    return own.groupBy("key").agg(F.every(F.coalesce("bad", F.lit(False))).alias("all")).filter("all").select("key")


def american_only(words: DataFrame, senses: DataFrame, entries: DataFrame, sense_edges: DataFrame, american: str = "American spelling", british: str = "British spelling") -> DataFrame:
    """(key): words marked as one spelling and never as the other."""
    marks = senses.filter(F.col("lemma").isin(american, british)).select(F.col("id").alias("dst_sense"), F.col("lemma").alias("mark"))
    own = senses.join(entries.select(F.col("id").alias("entry_id"), F.col("lemma_key").alias("key")), "entry_id").select(F.col("id").alias("src_sense"), "key")
    found = sense_edges.filter("rel = 'exemplifies'").join(marks, "dst_sense").join(own, "src_sense").join(words.select("key").distinct(), "key", "left_semi")
    return found.groupBy("key").agg(F.every(F.col("mark") == american).alias("only")).filter("only").select("key")


def british_forms(asked: DataFrame, senses: DataFrame, entries: DataFrame, sense_edges: DataFrame, american: str = "American spelling", british: str = "British spelling") -> DataFrame:
    """(synset, word, form): the British spelling of (synset, word) among the meaning's own words; else the word itself.

    Likely variants come first; a word marked as American also takes the meaning's first word marked as British.
    """
    own = asked.select("synset", "word").distinct()
    listed = senses.select(F.col("synset_id").alias("synset"), F.col("lemma").alias("form")).distinct()
    tried = own.select("synset", "word", F.posexplode(british_variants(F.col("word"))).alias("n", "form")).join(listed, ["synset", "form"]).groupBy("synset", "word").agg(F.min_by("form", "n").alias("variant"))
    only = american_only(own.select(lookup_key(F.col("word")).alias("key")), senses, entries, sense_edges, american, british)
    marked = senses.filter(F.col("lemma") == british).select(F.col("id").alias("dst_sense"))
    theirs = sense_edges.filter("rel = 'exemplifies'").join(marked, "dst_sense", "left_semi").join(senses.select(F.col("id").alias("src_sense"), F.col("synset_id").alias("synset"), "lemma", "member_rank"), "src_sense")
    theirs = theirs.groupBy("synset").agg(F.min_by("lemma", F.struct(F.col("member_rank").isNull(), "member_rank", "lemma")).alias("marked"))
    out = own.join(tried, ["synset", "word"], "left").withColumn("key", lookup_key(F.col("word"))).join(only.withColumn("american", F.lit(True)), "key", "left").join(theirs, "synset", "left")
    return out.select("synset", "word", F.coalesce("variant", F.when(F.col("american"), F.col("marked")), "word").alias("form"))


def display_form(word: Column) -> Column:
    plain = F.regexp_replace(F.replace(word, F.lit("’"), F.lit("'")), r"\s+", " ")
    return F.trim(plain, F.lit(" ,;:"))


def clean(words: DataFrame, lemma_keys: DataFrame, canonical: DataFrame, forms: DataFrame, bad: DataFrame, blocked: Column | None = None) -> DataFrame:
    """(word) to (word, clean, reason): the form in which a word of an old book may be shown, or why it may not.

    ``lemma_keys`` (key), ``canonical`` (key, lemma), ``forms`` (form): inflected words that have a lemma, ``bad`` (key);
    ``blocked`` is a condition on the column ``key``.  Reasons: junk, unfit, unknown_word, phrase_too_long, phrase_not_english.
    """
    own = words.select("word").distinct().withColumn("w", display_form(F.coalesce("word", F.lit(""))))
    own = own.withColumn("key", lookup_key(F.col("w"))).withColumn("junk", ~word_shape(F.col("w")) | F.col("w").endswith("."))
    known = lemma_keys.select("key").distinct()
    english = known.union(forms.select("form")).union(words.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, FUNCTION_WORDS))))).distinct().select(F.col("key").alias("part"))
    own = own.join(known.withColumn("known", F.lit(True)), "key", "left").join(bad.select("key", F.lit(True).alias("bad")).distinct(), "key", "left").join(canonical.select("key", "lemma"), "key", "left")
    # The parts of what is no lemma itself: hyphenated parts must be lemmas, parts of phrases English.
    open_ = own.filter("known is null and not junk").select("word", "key", F.posexplode(F.split("key", " ")).alias("t", "token"))
    parts = open_.select("word", "t", "token", F.explode(F.split("token", "-")).alias("part")).filter("part != ''")
    parts = parts.join(known.select(F.col("key").alias("part"), F.lit(1).alias("lemma_part")), "part", "left").join(english.withColumn("word_part", F.lit(1)), "part", "left")
    function = F.col("token").isin(FUNCTION_WORDS)
    per_token = parts.groupBy("word", "t", "token").agg(F.min(F.coalesce("lemma_part", F.lit(0))).alias("lemmas"), F.min(F.coalesce("word_part", F.lit(0))).alias("english"))
    per = per_token.groupBy("word").agg(
        F.min("lemmas").alias("lemmas"), F.min(F.when(function, 1).otherwise(F.col("english"))).alias("english"), F.sum(F.when(function, 0).otherwise(1)).alias("content")
    )
    own = own.join(per, "word", "left").withColumn("n", F.size(F.split("key", " ")))
    unfit = F.coalesce("bad", F.lit(False)) | (F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False))
    compound = F.col("key").contains("-") & (F.col("lemmas") == 1)
    reason = F.when(F.col("junk"), "junk").when(unfit, "unfit").when(F.col("known"), None).when((F.col("n") == 1) & F.coalesce(compound, F.lit(False)), None)
    reason = reason.when(F.col("n") == 1, "unknown_word").when(F.col("n") > LONGEST_PHRASE, "phrase_too_long")
    reason = reason.when(F.coalesce((F.col("english") == 1) & (F.col("content") > 0), F.lit(False)), None).otherwise("phrase_not_english")
    out = own.withColumn("reason", reason)
    form = F.when(F.col("known"), F.coalesce("lemma", "w")).otherwise(F.col("w"))
    return out.select("word", F.when(F.col("reason").isNull(), form).alias("clean"), "reason")


def fits_pos(words: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, pos) to (key, pos, fits): single words must be known with the part of speech; phrases and unknown compounds pass."""
    own = words.select("key", "pos").distinct()
    with_pos = entries.select(F.col("lemma_key").alias("key"), folded(F.col("pos")).alias("pos"), F.lit(True).alias("exact")).distinct()
    known = entries.select(F.col("lemma_key").alias("key"), F.lit(True).alias("known")).distinct()
    out = own.join(with_pos, ["key", "pos"], "left").join(known, "key", "left")
    fits = F.col("key").contains(" ") | F.coalesce("exact", F.lit(False)) | (F.col("key").contains("-") & F.col("known").isNull())
    return out.select("key", "pos", fits.alias("fits"))


def canonical_forms(senses: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, lemma): the spelling of a key's first meaning."""
    own = entries.select(F.col("lemma_key").alias("key"), "lemma", F.col("id").alias("entry_id")).join(senses.select("entry_id", "rank"), "entry_id")
    by = Window.partitionBy("key").orderBy("rank", "entry_id")
    return own.withColumn("n", F.row_number().over(by)).filter("n = 1").select("key", "lemma")
