"""Names and the full set of part-of-speech cues, for the tokens of a batch of sentences.

``words`` is the result of ``picker.sentence_tokens``; sentences without tokens give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.rules import CUE_CAP
from lexloom.functions.text import lookup_key


def names(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(qid, j): tokens that name a person; ``lexicon`` is (key, lemma, lexfile), one row per sense.

    A capitalised word is a name unless the lexicon has it with that capital as anything but a person; the first word of
    a sentence only if the lexicon has no lower-case word of its spelling, either.  Words in capitals are emphasis.
    """
    shaped = F.col("word").rlike(r"^\p{Lu}") & ((F.col("word") != F.upper("word")) | (F.length("word") == 1))
    base = F.regexp_replace("word", "['’]s$", "")
    own = words.filter(shaped).select("qid", "j", base.alias("lemma"), lookup_key(base).alias("key"))
    proper = lexicon.filter("lexfile is null or lexfile != 'noun.person'").select("lemma").distinct()
    common = lexicon.filter(F.col("lemma") == F.lower("lemma")).select("key", F.lit(True).alias("common")).distinct()
    own = own.join(proper, "lemma", "left_anti").join(common, "key", "left")
    return own.filter("j > 0 or common is null").select("qid", "j")


def full_cues(queries: DataFrame, words: DataFrame, lemmas: DataFrame, stop: DataFrame, named: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """(qid, j, pos, strength, ord): hints of the words around each token.

    ``lemmas`` is (word, lemma, pos) for lower-case words, ``named`` the result of ``names``, ``lists`` a few dozen words.
    """
    verb = F.max(F.when((F.col("pos") == "v") & (F.col("lemma") != F.col("word")), 1).otherwise(0)) == 1
    kinds = lemmas.groupBy(F.col("word").alias("low")).agg(F.collect_set("pos").alias("can"), verb.alias("inflected"))
    own = words.join(kinds, "low", "left").join(stop.select(F.col("key").alias("low"), F.lit(True).alias("is_stop")).distinct(), "low", "left")
    own = own.join(named.select("qid", "j", F.lit(True).alias("is_name")).distinct(), ["qid", "j"], "left").join(queries.select("qid", "sentence"), "qid")
    own = own.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_stop", "is_name", "inflected")}).withColumn("can", F.coalesce("can", F.array().cast("array<string>")))
    by = Window.partitionBy("qid").orderBy("j")
    near = {f"{c}{d}": F.lag(c, d).over(by) for c in ("low", "is_stop") for d in (1, 2, 3, 4)}
    near |= {"can1": F.lag("can").over(by), "is_name1": F.lag("is_name").over(by), "next": F.lead("low").over(by), "next_stop": F.lead("is_stop").over(by), "next_can": F.lead("can").over(by)}
    own = own.withColumns(near)

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    def among(name: str, c: str) -> Column:
        return yes(F.col(c).isin(lists.get(name, [])))

    before, can_be = F.col("low1"), lambda p: F.array_contains("can", p)
    possessive = yes(before.endswith("'s") | before.endswith("s'"))
    determined = among("determiners", "low1") | possessive
    modifier = yes(~F.col("is_stop1") & (F.size("can1") > 0) & (F.size(F.array_except("can1", F.array(F.lit("a"), F.lit("r")))) == 0))
    modifier &= among("determiners", "low2") | F.col("low2").isNull() | can_be("n")
    further = among("determiners", "low3") | yes(~F.col("is_stop3")) & among("determiners", "low4")
    reached = among("determiners", "low2") | ~F.col("inflected") & yes(~F.col("is_stop2")) & further
    reached &= yes(~F.col("is_stop1")) & ~among("degree", "low1")
    next_noun = yes(~F.col("next_stop") & F.array_contains("next_can", "n"))
    adjective_or_noun = F.when(next_noun & can_be("a"), "a").otherwise("n")
    cried = F.substring(F.col("sentence"), F.col("start") + F.length("word") + 1, F.lit(1)) == "!"
    opening = (F.col("j") == 0) & (F.col("next").isNull() | among("determiners", "next") | among("subjects", "next") | yes(cried))
    hint = lambda pos, v: F.struct(pos.alias("pos"), F.lit(v).alias("v"))
    noun, a_verb, adjective = F.lit("n"), F.lit("v"), F.lit("a")
    rules = [
        F.when(determined, hint(adjective_or_noun, 1.0)).when(modifier, hint(noun, 1.0)).when(reached, hint(adjective_or_noun, 0.8)).when(among("prepositions", "low1"), hint(noun, 0.6)),
        F.when(among("modals", "low1") | among("subjects", "low1") | yes(before == "please"), hint(a_verb, 1.0)),
        F.when(among("determiners", "next") & ~determined & ~among("prepositions", "low1"), hint(a_verb, 0.5)),
        F.when(among("copulas", "low1") & (F.col("inflected") | F.col("low").endswith("ing")), hint(a_verb, 0.6)),
        F.when(among("copulas", "low1"), hint(adjective, 0.8)),
        F.when(among("degree", "low1"), hint(adjective, 1.0)),
        F.when(opening, hint(a_verb, 0.8)),
        F.when(F.col("inflected") & ~determined & yes(~F.col("is_stop1")) & yes(F.col("is_name1")), hint(a_verb, 0.8)),
    ]
    out = own.select("qid", "j", F.posexplode(F.array_compact(F.array(*rules))).alias("ord", "h"))
    return out.groupBy("qid", "j", F.col("h.pos").alias("pos")).agg(F.least(F.sum("h.v"), F.lit(CUE_CAP)).alias("strength"), F.min("ord").alias("ord"))
