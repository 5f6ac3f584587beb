"""A lexicon made by rule from the part table, as the lexicon source would give it; for queries and benches.

Part k is a meaning ``y<k>`` with two members: a word of its own ("bolta") and its two-word name ("blue bolt").  Words
recur, so they have many meanings; tens of parts share a hypernym; every few parts are similar, opposite or derived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import lookup_key
from lexloom.sources.scratch import cut

SOURCE = "base"
#: Parts in one file of the dealt part table, about; so many are worked on in one task.
TASK_PARTS = 50_000


def _synset(k: Column) -> Column:
    return F.concat(F.lit("y"), k.cast("string"))


def _letter(k: Column, n: int) -> Column:
    return F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (k % n + 1).cast("int"), 1)


def lexicon(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """synsets, examples, entries, forms, pronunciations, senses, sense_relations, synset_relations.

    The part table may be one small file that holds a million rows, so it is dealt out first.  All tables grow with it and
    their sizes are guessed from that file, so none of them may be broadcast.
    """
    p = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_name is not null").select(F.col("p_partkey").alias("k"), F.lower("p_name").alias("name"), F.lower("p_type").alias("kind"), "p_size")
    p = p.withColumn("pos", F.element_at(F.array(*map(F.lit, "nvas")), (F.col("k") % 4 + 1).cast("int")))
    p = p.withColumn("word", F.concat(F.element_at(F.split("name", " "), -1), _letter(F.col("k"), 13)))
    tasks = max(spark.sparkContext.defaultParallelism, -(-p.count() // TASK_PARTS))
    p = cut(p.repartition(tasks, "k"), "parts")
    k, src = F.col("k"), F.lit(SOURCE).alias("source")
    definition = F.concat(F.lit("the "), F.col("name"), F.lit(" of a "), F.col("kind"), F.lit(" "), F.element_at(F.split("name", " "), 1), _letter(k, 7))
    out = {"synsets": p.select(_synset(k).alias("id"), "pos", F.concat(F.lit("noun."), "kind").alias("lexfile"), definition.alias("definition"), F.when(F.col("p_size") == 1, "Colloquial").otherwise("").alias("origin"), src)}
    out["examples"] = p.filter("k % 3 = 0").select(_synset(k).alias("synset_id"), F.lit(1).alias("seq"), F.concat(F.lit("put a "), "word", F.lit(" by the "), "kind", F.lit(" door")).alias("text"), src)
    members = p.select("k", "pos", F.posexplode(F.array("word", "name")).alias("m", "lemma"))
    entry = lambda c: F.concat(F.lit("e-"), F.replace(F.col(c), F.lit(" "), F.lit("_")), F.lit("-"), F.col("pos"))
    senses = members.select(F.concat(_synset(k), F.lit("."), F.col("m").cast("string")).alias("id"), entry("lemma").alias("entry_id"), "lemma", "pos", _synset(k).alias("synset_id"), "k", F.col("m").cast("int").alias("m"))
    rank = F.row_number().over(Window.partitionBy("entry_id").orderBy("k", "m"))
    out["senses"] = senses.select("id", "entry_id", "lemma", "pos", "synset_id", rank.alias("rank"), (F.col("m") + 1).alias("member_rank"), src)
    words = members.select(entry("lemma").alias("id"), "lemma", "pos").distinct()
    out["entries"] = words.select("id", "lemma", lookup_key(F.col("lemma")).alias("lemma_key"), "pos", src)
    single = words.filter(~F.col("lemma").contains(" "))
    out["forms"] = single.filter("pos = 'v'").select(F.col("id").alias("entry_id"), F.concat("lemma", F.lit("en")).alias("form"), F.concat("lemma", F.lit("en")).alias("form_key"), src)
    said = F.explode(F.array(F.struct(F.lit("US").alias("variety"), F.upper("lemma").alias("ipa")), F.struct(F.lit("GB").alias("variety"), F.reverse("lemma").alias("ipa"))))
    out["pronunciations"] = single.select(F.col("id").alias("entry_id"), said.alias("s")).select("entry_id", "s.variety", "s.ipa", src)
    n = F.col("k")
    link = lambda rows, rel, a, b: rows.select(_synset(a).alias("src"), F.lit(rel).alias("rel"), _synset(b).alias("dst"))
    up, alike = p.filter("k >= 10"), p.filter("k % 5 = 0 and k > 0")
    edges = [link(up, "hypernym", n, F.floor(n / 10)), link(up, "hyponym", F.floor(n / 10), n), link(alike, "similar", n, n - 1), link(alike, "similar", n - 1, n), link(p.filter("k % 9 = 1"), "also", n, n - 1), link(p.filter("k % 40 = 3"), "exemplifies", n, F.lit(2))]
    both = edges[0]
    for e in edges[1:]:
        both = both.union(e)
    known = out["synsets"].select(F.col("id").alias("dst")).hint("merge")
    out["synset_relations"] = both.distinct().join(known, "dst", "left_semi").select("src", "rel", "dst", src)
    sense = lambda a, m: F.concat(_synset(a), F.lit(f".{m}"))
    slink = lambda rows, rel, a, ma, b, mb: rows.select(sense(a, ma).alias("src_sense"), F.lit(rel).alias("rel"), sense(b, mb).alias("dst_sense"))
    pairs = [slink(p.filter("k % 7 = 0 and k > 1"), "antonym", n, 0, n - 2, 0), slink(p.filter("k % 7 = 0 and k > 1"), "antonym", n - 2, 0, n, 0), slink(p.filter("k % 6 = 0 and k > 3"), "derivation", n, 0, n - 3, 0), slink(p.filter("k % 11 = 5"), "exemplifies", n, 0, F.lit(7), 0), slink(p.filter("k % 11 = 4"), "exemplifies", n, 0, F.lit(8), 0)]
    both = pairs[0]
    for e in pairs[1:]:
        both = both.union(e)
    ids = members.select(F.concat(_synset(k), F.lit("."), F.col("m").cast("string")).alias("dst_sense")).hint("merge")
    out["sense_relations"] = both.distinct().join(ids, "dst_sense", "left_semi").select("src_sense", "rel", "dst_sense", F.lit("").alias("subtype"), src)
    return {name: own.hint("merge") for name, own in out.items()}


def unfit(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(unfit meanings (id), bad words (key)): every 29th meaning, and the words that end in "m"."""
    number = F.substring("id", 2, 20).cast("long")
    words = t["entries"].filter("lemma_key like '%m' and lemma_key not like '% %'").select(F.col("lemma_key").alias("key")).distinct()
    return t["synsets"].filter(number % 29 == 28).select("id"), words


#: The same lexicon in DuckDB's SQL, as common table expressions.
SQL = """p AS (SELECT p_partkey AS k, lower(p_name) AS name, lower(p_type) AS kind, p_size, ['n','v','a','s'][CAST(p_partkey % 4 + 1 AS INT)] AS pos,
 string_split(lower(p_name), ' ')[-1] || substr('abcdefghijklmnopqrstuvwxyz', CAST(p_partkey % 13 + 1 AS INT), 1) AS word FROM part WHERE p_name IS NOT NULL),
synsets AS (SELECT 'y' || k AS id, pos, 'noun.' || kind AS lexfile, 'the ' || name || ' of a ' || kind || ' ' || string_split(name, ' ')[1] || substr('abcdefghijklmnopqrstuvwxyz', CAST(k % 7 + 1 AS INT), 1) AS definition,
 CASE WHEN p_size = 1 THEN 'Colloquial' ELSE '' END AS origin FROM p),
examples AS (SELECT 'y' || k AS synset_id, 1 AS seq, 'put a ' || word || ' by the ' || kind || ' door' AS text FROM p WHERE k % 3 = 0),
members AS (SELECT k, pos, 0 AS m, word AS lemma FROM p UNION ALL SELECT k, pos, 1, name FROM p),
senses AS (SELECT 'y' || k || '.' || m AS id, 'e-' || replace(lemma, ' ', '_') || '-' || pos AS entry_id, lemma, pos, 'y' || k AS synset_id, row_number() OVER (PARTITION BY lemma, pos ORDER BY k, m) AS rank, m + 1 AS member_rank FROM members),
entries AS (SELECT DISTINCT 'e-' || replace(lemma, ' ', '_') || '-' || pos AS id, lemma, lemma AS lemma_key, pos FROM members),
forms AS (SELECT id AS entry_id, lemma || 'en' AS form, lemma || 'en' AS form_key FROM entries WHERE pos = 'v' AND NOT contains(lemma, ' ')),
pronunciations AS (SELECT id AS entry_id, 'US' AS variety, upper(lemma) AS ipa FROM entries WHERE NOT contains(lemma, ' ') UNION ALL SELECT id, 'GB', reverse(lemma) FROM entries WHERE NOT contains(lemma, ' ')),
synset_relations AS (SELECT DISTINCT 'y' || a AS src, rel, 'y' || b AS dst FROM (SELECT k AS a, 'hypernym' AS rel, k // 10 AS b FROM p WHERE k >= 10 UNION ALL SELECT k // 10, 'hyponym', k FROM p WHERE k >= 10
 UNION ALL SELECT k, 'similar', k - 1 FROM p WHERE k % 5 = 0 AND k > 0 UNION ALL SELECT k - 1, 'similar', k FROM p WHERE k % 5 = 0 AND k > 0
 UNION ALL SELECT k, 'also', k - 1 FROM p WHERE k % 9 = 1 UNION ALL SELECT k, 'exemplifies', 2 FROM p WHERE k % 40 = 3) WHERE b IN (SELECT k FROM p)),
sense_relations AS (SELECT DISTINCT 'y' || a || '.0' AS src_sense, rel, 'y' || b || '.0' AS dst_sense FROM (SELECT k AS a, 'antonym' AS rel, k - 2 AS b FROM p WHERE k % 7 = 0 AND k > 1 UNION ALL SELECT k - 2, 'antonym', k FROM p WHERE k % 7 = 0 AND k > 1
 UNION ALL SELECT k, 'derivation', k - 3 FROM p WHERE k % 6 = 0 AND k > 3 UNION ALL SELECT k, 'exemplifies', 7 FROM p WHERE k % 11 = 5 UNION ALL SELECT k, 'exemplifies', 8 FROM p WHERE k % 11 = 4) WHERE b IN (SELECT k FROM p)),
unfit AS (SELECT id FROM synsets WHERE CAST(substr(id, 2) AS BIGINT) % 29 = 28),
bad AS (SELECT DISTINCT lemma_key AS key FROM entries WHERE ends_with(lemma_key, 'm') AND NOT contains(lemma_key, ' '))"""
