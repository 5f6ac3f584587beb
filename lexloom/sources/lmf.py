"""Lexicon XML (WN-LMF) to typed tables, with Spark's XML reader and explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = """_id string, Lemma struct<_writtenForm: string, _partOfSpeech: string, Pronunciation: array<struct<_VALUE: string, _variety: string>>>,
Form array<struct<_writtenForm: string>>, Sense array<struct<_id: string, _synset: string, _adjposition: string,
SenseRelation: array<struct<_relType: string, _target: string, `_dc:type`: string>>>>"""
SYNSET = """_id string, _ili string, _partOfSpeech string, _lexfile string, `_dc:subject` string, `_dc:source` string, _members string,
Definition array<string>, Example array<struct<_VALUE: string, `_dc:source`: string>>, SynsetRelation array<struct<_relType: string, _target: string>>"""


def squash(c):
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def read(spark: SparkSession, path: str, source: str) -> dict[str, DataFrame]:
    """entries, forms, pronunciations, senses, sense_relations, synsets, examples, synset_relations."""
    load = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "false").schema(schema).load(path)
    e, s = load("LexicalEntry", ENTRY), load("Synset", SYNSET)
    src = F.lit(source).alias("source")
    from lexloom.functions.text import lookup_key

    lemma, pos = F.col("Lemma._writtenForm"), F.col("Lemma._partOfSpeech")
    out = {"entries": e.select(F.col("_id").alias("id"), lemma.alias("lemma"), lookup_key(lemma).alias("lemma_key"), pos.alias("pos"), src)}
    forms = e.select(F.col("_id").alias("entry_id"), F.explode("Form._writtenForm").alias("form"))
    out["forms"] = forms.select("entry_id", "form", lookup_key(F.col("form")).alias("form_key"), src)
    pron = e.select(F.col("_id").alias("entry_id"), F.inline("Lemma.Pronunciation"))
    out["pronunciations"] = pron.filter(F.trim("_VALUE") != "").select("entry_id", F.col("_variety").alias("variety"), F.trim("_VALUE").alias("ipa"), src)
    sense = e.select(F.col("_id").alias("entry_id"), lemma.alias("lemma"), pos.alias("pos"), F.posexplode("Sense").alias("n", "s"))
    members = s.select(F.col("_id").alias("m_synset"), F.posexplode(F.split(squash(F.col("_members")), " ")).alias("m", "member"))
    senses = sense.join(members, (F.col("s._synset") == F.col("m_synset")) & (F.col("member").isin(F.col("entry_id")) | (F.col("member") == F.col("s._id"))), "left")
    out["senses"] = senses.select(F.col("s._id").alias("id"), "entry_id", "lemma", "pos", F.col("s._synset").alias("synset_id"), (F.col("n") + 1).alias("rank"), (F.col("m") + 1).alias("member_rank"), F.col("s._adjposition").alias("adjposition"), src)
    rel = sense.select(F.col("s._id").alias("src_sense"), F.inline("s.SenseRelation"))
    out["sense_relations"] = rel.select("src_sense", F.col("_relType").alias("rel"), F.col("_target").alias("dst_sense"), F.coalesce("`_dc:type`", F.lit("")).alias("subtype"), src).distinct()
    ili = F.when(F.col("_ili").isin("", "in"), None).otherwise(F.col("_ili"))
    definition = F.array_join(F.transform("Definition", squash), "; ")
    out["synsets"] = s.select(F.col("_id").alias("id"), F.col("_partOfSpeech").alias("pos"), ili.alias("ili"), F.coalesce("_lexfile", "`_dc:subject`").alias("lexfile"), F.coalesce(definition, F.lit("")).alias("definition"), F.coalesce("`_dc:source`", F.lit("")).alias("origin"), src)
    ex = s.select(F.col("_id").alias("synset_id"), F.posexplode("Example").alias("n", "x")).select("synset_id", "n", squash(F.col("x._VALUE")).alias("text"), F.coalesce(F.col("x.`_dc:source`"), F.lit("")).alias("origin"))
    by = Window.partitionBy("synset_id").orderBy("n")
    out["examples"] = ex.filter("text != ''").select("synset_id", F.row_number().over(by).alias("seq"), "text", "origin", src)
    links = s.select(F.col("_id").alias("src"), F.inline("SynsetRelation"))
    out["synset_relations"] = links.select("src", F.col("_relType").alias("rel"), F.col("_target").alias("dst"), F.lit(source).alias("source")).distinct()
    return out


def integrity(t: dict[str, DataFrame]) -> DataFrame:
    """(name, n): references that name nothing, and synsets without a sense."""
    ids = lambda d, c: d.select(F.col(c).alias("ref"))
    pairs = {
        "sense_entry": (ids(t["senses"], "entry_id"), ids(t["entries"], "id")),
        "sense_synset": (ids(t["senses"], "synset_id"), ids(t["synsets"], "id")),
        "sense_relation": (ids(t["sense_relations"], "dst_sense"), ids(t["senses"], "id")),
        "synset_relation": (ids(t["synset_relations"], "dst"), ids(t["synsets"], "id")),
        "empty_synset": (ids(t["synsets"], "id"), ids(t["senses"], "synset_id")),
    }
    out = None
    for name, (a, b) in pairs.items():
        n = a.join(b.distinct(), "ref", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.union(n)
    return out
