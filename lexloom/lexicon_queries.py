"""Registered queries of the lexicon operators over the sample lexicon (see plans/sample.py), and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions import text as fn
from lexloom.operators import evaluate, features, graph, lexicon, picker, screen, search, vocabulary
from lexloom.plans import assembly, sample, serving
from lexloom.queries import STOP, register, stop_table, table
from lexloom.sources import scratch, stores, synonymy, thesaurus

_LEX = f"WITH {sample.SQL}"
_STOP = ", ".join(f"('{w}')" for w in [*STOP, "a", "by"])
_FOLD = "CASE WHEN pos = 's' THEN 'a' ELSE pos END"


def stops(spark):
    return F.broadcast(stop_table(spark).union(spark.range(1).select(F.explode(F.array(F.lit("a"), F.lit("by"))))))


# ---- parts of speech, spellings

@register("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'a,s' WHEN 2 THEN 'r' END AS codes, p_partkey % 4 = 3 AS none FROM part")
def normalise_pos(spark, sf_dir):
    alias = F.element_at(F.array(F.lit(" Noun"), F.lit("adj"), F.lit("ADVERB"), F.lit(None).cast("string")), (F.col("p_partkey") % 4 + 1).cast("int"))
    own = table(spark, sf_dir, "part").select("p_partkey", fn.normalise_pos(alias).alias("c"))
    return own.select("p_partkey", F.when(F.size("c") > 0, F.array_join("c", ",")).alias("codes"), (F.size("c") == 0).alias("none"))


@register(
    r"""WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://www.creativecommons.org/licenses/by/4.0/' WHEN 1 THEN url END AS url FROM pages)
SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN 'unknown' WHEN rtrim(regexp_replace(url, '^https?://(www\.)?', ''), '/') = 'creativecommons.org/licenses/by/4.0' THEN 'Creative Commons Attribution 4.0 International (CC BY 4.0)' ELSE url END AS label FROM u"""
)
def license_label(spark, sf_dir):
    url = F.when(F.col("page_id") % 3 == 0, "https://www.creativecommons.org/licenses/by/4.0/").when(F.col("page_id") % 3 == 1, F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", fn.license_name(url).alias("label"))


@register(r"SELECT doc_id, count(*) AS n, md5(string_agg(regexp_replace(regexp_replace(w, '^[^\p{L}\p{M}\p{N}_]+', ''), '[^\p{L}\p{M}\p{N}_]+$', ''), ' ' ORDER BY i)) AS words_md5 FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents) WHERE NOT contains(w, chr(10)) GROUP BY doc_id")
def edge_punctuation(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", " ", -1), lambda w: ~w.contains("\n")).alias("w")).filter(F.size("w") > 0)
    return own.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join(F.transform("w", fn.edge_strip), " ")).alias("words_md5"))


@register(r"SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(w, '^[\p{L}\p{Nl}\p{No}][\p{L}\p{M}\p{Nl}\p{No}]*([ ''’.-]+[\p{L}\p{Nl}\p{No}]+)*\.?$') THEN 1 ELSE 0 END) AS BIGINT) AS words FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) GROUP BY doc_id")
def word_shapes(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1)).alias("w"))
    return own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(fn.word_shape(F.col("w")), 1).otherwise(0)).alias("words"))


# ---- graph

@register(f"{_LEX} SELECT synset_id AS synset, string_agg(lemma, '|' ORDER BY member_rank, lemma) AS members FROM senses GROUP BY synset_id")
def synset_members(spark, sf_dir):
    return graph.members(sample.lexicon(spark, sf_dir)["senses"]).select("synset", F.array_join("members", "|").alias("members"))


@register(f"{_LEX} SELECT src, rel, row_number() OVER (PARTITION BY src, rel ORDER BY dst) AS place, dst, definition, (SELECT string_agg(lemma, '|' ORDER BY member_rank) FROM senses WHERE synset_id = dst) AS members FROM synset_relations JOIN synsets ON id = dst WHERE rel IN ('hypernym', 'hyponym')")
def related_synsets(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    asked = t["synset_relations"].filter("rel in ('hypernym', 'hyponym')")
    return graph.related(asked, t["synset_relations"], t["synsets"], t["senses"]).withColumns({"place": F.col("place").cast("long"), "members": F.array_join("members", "|")})


@register(
    f"""{_LEX}, w AS (SELECT src, rel, dst FROM synset_relations WHERE rel <> 'exemplifies' UNION SELECT a.synset_id, rel, b.synset_id FROM sense_relations JOIN senses a ON a.id = src_sense JOIN senses b ON b.id = dst_sense WHERE rel = 'derivation' AND a.synset_id <> b.synset_id)
SELECT src, rel, dst, CAST(CASE rel WHEN 'hypernym' THEN 0.7 WHEN 'similar' THEN 0.7 ELSE 0.6 END AS DOUBLE) AS w FROM w"""
)
def weighted_relations(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    return graph.weighted(t["synset_relations"], t["sense_relations"], t["senses"])


_OF = f"own AS (SELECT lemma_key AS key, {_FOLD} AS pos, e.id AS entry_id, synset_id, rank FROM entries e JOIN senses s ON s.entry_id = e.id)"


@register(
    f"""{_LEX}, {_OF.replace(_FOLD, "CASE WHEN e.pos = 's' THEN 'a' ELSE e.pos END")}, f AS (SELECT key, pos, synset_id, min((CASE pos WHEN 'n' THEN 0 WHEN 'v' THEN 1 ELSE 2 END, entry_id, rank)) AS m FROM own GROUP BY key, pos, synset_id)
SELECT key, pos, row_number() OVER (PARTITION BY key, pos ORDER BY m) AS place, synset_id AS synset FROM f"""
)
def synsets_of_words(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    words = t["entries"].select(F.col("lemma_key").alias("key"), graph.folded(F.col("pos")).alias("pos"))
    return graph.synsets_of(words, t["entries"], t["senses"]).select("key", "pos", F.col("place").cast("long").alias("place"), "synset")


_NEAR = """ways AS (SELECT src, dst, 1 AS p FROM synset_relations WHERE rel IN ('similar', 'also') UNION ALL SELECT a.src, b.dst, 1 FROM synset_relations a JOIN synset_relations b ON a.dst = b.src AND a.rel IN ('similar', 'also') AND b.rel = 'similar'
UNION ALL SELECT src, dst, 2 FROM synset_relations WHERE rel = 'hypernym' UNION ALL SELECT src, dst, 3 FROM synset_relations WHERE rel = 'hyponym' UNION ALL SELECT a.src, b.src, 4 FROM synset_relations a JOIN synset_relations b ON a.dst = b.dst AND a.rel = 'hypernym' AND b.rel = 'hypernym'),
near AS (SELECT src, dst, min(p) AS p FROM ways WHERE src <> dst GROUP BY src, dst)"""


@register(
    f"""{_LEX}, {_NEAR}, asked AS (SELECT 'y' || a.k AS synset, b.word AS key, CASE WHEN a.pos = 's' THEN 'a' ELSE a.pos END AS pos FROM p a JOIN p b ON b.k IN (a.k, a.k - 1, a.k // 10, a.k * 10 + 3, a.k - 10, a.k + 4)),
ask AS (SELECT DISTINCT * FROM asked UNION SELECT DISTINCT synset, 'no such word', pos FROM asked),
own AS (SELECT DISTINCT e.lemma_key AS key, CASE WHEN e.pos = 's' THEN 'a' ELSE e.pos END AS pos, synset_id AS dst FROM entries e JOIN senses s ON s.entry_id = e.id),
l AS (SELECT ask.synset, ask.key, ask.pos, min(CASE WHEN own.dst IS NULL THEN 6 WHEN own.dst = ask.synset THEN 0 ELSE coalesce(near.p, 5) END) AS n FROM ask LEFT JOIN own ON own.key = ask.key AND own.pos = ask.pos LEFT JOIN near ON near.src = ask.synset AND near.dst = own.dst GROUP BY ALL)
SELECT synset, key, pos, ['member', 'similar', 'hypernym', 'hyponym', 'sibling', 'far', 'unknown'][n + 1] AS label FROM l"""
)
def relation_labels(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    own = t["senses"].filter("member_rank = 1").select(F.substring("synset_id", 2, 20).cast("long").alias("k"), graph.folded(F.col("pos")).alias("pos"), F.col("lemma").alias("key"))
    steps = F.explode(F.array(F.col("k"), F.col("k") - 1, F.floor(F.col("k") / 10), F.col("k") * 10 + 3, F.col("k") - 10, F.col("k") + 4)).alias("b")
    asked = own.select("k", "pos", steps).join(own.select(F.col("k").alias("b"), "key"), "b").select(F.concat(F.lit("y"), F.col("k").cast("string")).alias("synset"), "key", "pos")
    asked = asked.union(asked.select("synset", F.lit("no such word"), "pos"))
    return graph.relation(asked, t["synset_relations"], t["entries"], t["senses"])


@register(
    f"""{_LEX}, ref AS (SELECT id AS ref, id AS sense, synset_id, 0 AS m FROM senses WHERE member_rank = 1 UNION ALL SELECT synset_id, id, synset_id, member_rank FROM senses),
opp AS (SELECT src_sense, dst_sense FROM sense_relations WHERE rel = 'antonym'),
direct AS (SELECT ref, dst_sense, min((0, m, sense)) AS o FROM ref JOIN opp ON src_sense = sense GROUP BY ref, dst_sense),
far AS (SELECT DISTINCT ref, opp.dst_sense, (1, 0, '') AS o FROM ref JOIN synset_relations r ON r.src = ref.synset_id AND r.rel = 'similar' JOIN synsets h ON h.id = r.dst AND h.pos = 'a' JOIN senses s ON s.synset_id = h.id JOIN opp ON src_sense = s.id WHERE ref NOT IN (SELECT ref FROM direct)),
both_ AS (SELECT * FROM direct UNION ALL SELECT * FROM far)
SELECT ref, row_number() OVER (PARTITION BY ref ORDER BY o, dst_sense) AS place, dst_sense AS sense, lemma, synset_id AS synset, o[1] = 1 AS indirect FROM both_ JOIN senses ON id = dst_sense"""
)
def sense_antonyms(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    refs = t["senses"].filter("member_rank = 1").select(F.col("id").alias("ref")).union(t["synsets"].select("id"))
    return graph.sense_antonyms(refs, t["senses"], t["sense_relations"], t["synset_relations"], t["synsets"]).withColumn("place", F.col("place").cast("long"))


@register(
    f"""{_LEX}, f AS (SELECT r.src AS synset, a.word AS lemma, s.lemma AS key, min((CASE r.rel WHEN 'hyponym' THEN 0 ELSE 1 END, r.dst)) AS o FROM synset_relations r JOIN p a ON 'y' || a.k = r.src JOIN senses s ON s.synset_id = r.dst AND s.member_rank = 1
 WHERE r.rel IN ('hyponym', 'hypernym') AND r.dst NOT IN (SELECT id FROM unfit) AND s.lemma NOT IN (SELECT key FROM bad) AND s.lemma <> a.word GROUP BY 1, 2, 3)
SELECT synset, lemma, place, key AS word, CASE WHEN o[1] = 0 THEN 'more specific' ELSE 'more general' END AS relation FROM (SELECT *, row_number() OVER (PARTITION BY synset, lemma ORDER BY o) AS place FROM f) WHERE place <= 4"""
)
def related_words(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    unfit, bad = sample.unfit(t)
    asked = t["senses"].filter("member_rank = 1").select(F.col("synset_id").alias("synset"), "lemma")
    return graph.related_words(asked, t["synset_relations"], t["senses"], t["entries"], unfit, bad).withColumn("place", F.col("place").cast("long"))


# ---- what may be shown

@register(
    f"""{_LEX}, d AS (SELECT DISTINCT synset_id AS id FROM senses WHERE lemma IN (SELECT word FROM p WHERE k IN (2, 7))),
r AS (SELECT src AS id, 'offensive' AS reason FROM synset_relations WHERE rel = 'exemplifies' AND dst IN (SELECT id FROM d) UNION ALL SELECT a.synset_id, 'offensive' FROM sense_relations JOIN senses a ON a.id = src_sense JOIN senses b ON b.id = dst_sense WHERE rel = 'exemplifies' AND b.synset_id IN (SELECT id FROM d)
UNION ALL SELECT id, 'modern_slang' FROM synsets WHERE origin = 'Colloquial') SELECT id, max(reason) AS reason FROM r GROUP BY id"""
)
def unfit_meanings(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    domains = sorted(r[0] for r in t["senses"].filter("id in ('y2.0', 'y7.0')").select("lemma").distinct().collect())
    return vocabulary.unfit_meanings(domains, "Colloquial", t["synsets"], t["senses"], t["sense_relations"], t["synset_relations"])


@register(f"{_LEX}, u AS (SELECT id FROM synsets WHERE CAST(substr(id, 2) AS BIGINT) % 13 = 5) SELECT e.lemma_key AS key FROM entries e JOIN senses s ON s.entry_id = e.id GROUP BY 1 HAVING bool_and(s.synset_id IN (SELECT id FROM u))")
def unfit_words(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    return vocabulary.unfit_words(t["senses"], t["entries"], t["synsets"].filter(F.substring("id", 2, 20).cast("long") % 13 == 5))


_MARK = "m AS (SELECT e.lemma_key AS key, d.lemma AS mark FROM sense_relations r JOIN senses s ON s.id = src_sense JOIN entries e ON e.id = s.entry_id JOIN senses d ON d.id = dst_sense WHERE rel = 'exemplifies' AND d.lemma IN (SELECT word FROM p WHERE k IN (7, 8)))"


@register(f"{_LEX}, {_MARK} SELECT key FROM m GROUP BY key HAVING bool_and(mark = (SELECT word FROM p WHERE k = 7))")
def american_spellings(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    us, gb = (t["senses"].filter(f"id = 'y{k}.0'").first().lemma for k in (7, 8))
    return vocabulary.american_only(t["entries"].select(F.col("lemma_key").alias("key")), t["senses"], t["entries"], t["sense_relations"], us, gb)


@register(
    f"""{_LEX}, {_MARK}, only_ AS (SELECT key FROM m GROUP BY key HAVING bool_and(mark = (SELECT word FROM p WHERE k = 7))),
gb AS (SELECT s.synset_id, arg_min(s.lemma, s.member_rank) AS form FROM sense_relations r JOIN senses s ON s.id = src_sense JOIN senses d ON d.id = dst_sense WHERE rel = 'exemplifies' AND d.lemma = (SELECT word FROM p WHERE k = 8) GROUP BY 1)
SELECT 'y' || k AS synset, word, CASE WHEN word IN (SELECT key FROM only_) THEN coalesce(gb.form, word) ELSE word END AS form FROM p LEFT JOIN gb ON gb.synset_id = 'y' || k"""
)
def british_spellings(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    us, gb = (t["senses"].filter(f"id = 'y{k}.0'").first().lemma for k in (7, 8))
    asked = t["senses"].filter("member_rank = 1").select(F.col("synset_id").alias("synset"), F.col("lemma").alias("word"))
    return vocabulary.british_forms(asked, t["senses"], t["entries"], t["sense_relations"], us, gb)


_RAW = "raw AS (SELECT DISTINCT CASE k % 8 WHEN 0 THEN word WHEN 1 THEN name WHEN 2 THEN word || '-' || word WHEN 3 THEN 'the ' || word || ' of a ' || kind WHEN 4 THEN 'zz' || word WHEN 5 THEN word || ' and ' || name || ' by the ' || word WHEN 6 THEN word || '.' ELSE 'the ' || word || 's' END AS word FROM p)"


@register(
    f"""{_LEX}, {_RAW}, known AS (SELECT DISTINCT lemma_key AS key FROM entries), fw(key) AS (VALUES {", ".join("('" + w.replace("'", "''") + "')" for w in vocabulary.FUNCTION_WORDS)}),
english AS (SELECT key FROM known UNION SELECT key FROM fw UNION SELECT key || 's' FROM known),
t AS (SELECT word, unnest(string_split(word, ' ')) AS tok FROM raw), h AS (SELECT word, tok, bool_and(part IN (SELECT key FROM known)) AS lem, bool_and(part IN (SELECT key FROM english)) AS eng FROM (SELECT word, tok, unnest(string_split(tok, '-')) AS part FROM t) GROUP BY word, tok),
g AS (SELECT word, bool_and(lem) AS lem, bool_and(eng OR tok IN (SELECT key FROM fw)) AS eng, count(*) FILTER (tok NOT IN (SELECT key FROM fw)) AS content FROM h GROUP BY word),
r AS (SELECT raw.word, CASE WHEN ends_with(raw.word, '.') THEN 'junk' WHEN raw.word IN (SELECT key FROM bad) THEN 'unfit' WHEN raw.word IN (SELECT key FROM known) THEN NULL WHEN NOT contains(raw.word, ' ') AND contains(raw.word, '-') AND lem THEN NULL
 WHEN NOT contains(raw.word, ' ') THEN 'unknown_word' WHEN len(string_split(raw.word, ' ')) > 4 THEN 'phrase_too_long' WHEN eng AND content > 0 THEN NULL ELSE 'phrase_not_english' END AS reason FROM raw JOIN g ON g.word = raw.word)
SELECT word, CASE WHEN reason IS NULL THEN word END AS clean, reason FROM r"""
)
def clean_words(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    p = t["senses"].filter("member_rank = 1").select(F.substring("synset_id", 2, 20).cast("long").alias("k"), F.col("lemma").alias("word"), "synset_id")
    p = p.join(t["senses"].filter("member_rank = 2").select("synset_id", F.col("lemma").alias("name")), "synset_id").join(t["synsets"].select(F.col("id").alias("synset_id"), F.substring("lexfile", 6, 99).alias("kind")), "synset_id")
    w, name, kind, k = F.col("word"), F.col("name"), F.col("kind"), F.col("k") % 8
    raw = F.when(k == 0, w).when(k == 1, name).when(k == 2, F.concat(w, F.lit("-"), w)).when(k == 3, F.concat(F.lit("the "), w, F.lit(" of a "), kind)).when(k == 4, F.concat(F.lit("zz"), w))
    raw = raw.when(k == 5, F.concat(w, F.lit(" and "), name, F.lit(" by the "), w)).when(k == 6, F.concat(w, F.lit("."))).otherwise(F.concat(F.lit("the "), w, F.lit("s")))
    keys = t["entries"].select(F.col("lemma_key").alias("key")).distinct()
    forms = keys.select(F.concat("key", F.lit("s")).alias("form"))
    return vocabulary.clean(p.select(raw.alias("word")), keys, vocabulary.canonical_forms(t["senses"], t["entries"]), forms, sample.unfit(t)[1])


@register(
    f"""{_LEX}, {_RAW}, a AS (SELECT DISTINCT word AS key, pos FROM raw, (VALUES ('n'), ('v'), ('a'), ('r')) v(pos))
SELECT key, pos, contains(key, ' ') OR (key, pos) IN (SELECT (lemma_key, CASE WHEN e.pos = 's' THEN 'a' ELSE e.pos END) FROM entries e) OR (contains(key, '-') AND key NOT IN (SELECT lemma_key FROM entries)) AS fits FROM a"""
)
def words_fit_pos(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    words = clean_words(spark, sf_dir).select(F.col("word").alias("key"), F.explode(F.array(*map(F.lit, "nvar"))).alias("pos"))
    return vocabulary.fits_pos(words, t["entries"])


# ---- lemmas and keys

_SURFACE = "surface AS (SELECT DISTINCT CASE k % 6 WHEN 0 THEN word || 's' WHEN 1 THEN '(' || word || ')' WHEN 2 THEN word || '''s' WHEN 3 THEN word || 'ing' WHEN 4 THEN word || 'en' ELSE 'No' || word END AS word FROM p)"
_POSN = "CASE pos WHEN 'n' THEN 0 WHEN 'v' THEN 1 WHEN 'r' THEN 3 ELSE 2 END"
_LEMMAS = f"""spelled AS (SELECT word, 0 AS n, lower(regexp_replace(word, '[()]', '', 'g')) AS form FROM surface UNION ALL SELECT word, 1, left(lower(word), length(word) - 2) FROM surface WHERE ends_with(word, '''s')),
stages AS (SELECT word, lemma, pos, (0, n, {_POSN}, 0, id) AS o FROM spelled JOIN entries ON lemma_key = spelled.form
UNION ALL SELECT word, lemma, pos, (1, n, {_POSN}, 0, id) FROM spelled JOIN forms ON forms.form_key = spelled.form JOIN entries ON id = entry_id
UNION ALL SELECT word, lemma, pos, (2, n, {_POSN}, 0, id) FROM spelled JOIN entries ON lemma_key = left(form, length(form) - 1) AND ends_with(form, 's') AND pos IN ('n', 'v')
UNION ALL SELECT word, lemma, pos, (2, n, 1, 1, id) FROM spelled JOIN entries ON lemma_key = left(form, length(form) - 3) AND ends_with(form, 'ing') AND pos = 'v'
UNION ALL SELECT word, lemma, pos, (2, n, 1, 2, id) FROM spelled JOIN entries ON lemma_key = left(form, length(form) - 3) || 'e' AND ends_with(form, 'ing') AND pos = 'v'
UNION ALL SELECT word, lemma, pos, (2, n, 1, 3, id) FROM spelled JOIN entries ON lemma_key = left(form, length(form) - 2) AND ends_with(form, 'es') AND pos = 'v'
UNION ALL SELECT word, lemma, pos, (2, n, 2, 1, id) FROM spelled JOIN entries ON lemma_key = left(form, length(form) - 2) AND ends_with(form, 'er') AND pos IN ('a', 's')),
lemma_of AS (SELECT word, lemma, CASE WHEN pos = 's' THEN 'a' ELSE pos END AS pos, min(o) AS o FROM stages GROUP BY ALL)"""


def surfaces(t):
    p = t["senses"].filter("member_rank = 1").select(F.substring("synset_id", 2, 20).cast("long").alias("k"), F.col("lemma").alias("w"))
    k, w = F.col("k") % 6, F.col("w")
    said = F.when(k == 0, F.concat(w, F.lit("s"))).when(k == 1, F.concat(F.lit("("), w, F.lit(")"))).when(k == 2, F.concat(w, F.lit("'s"))).when(k == 3, F.concat(w, F.lit("ing"))).when(k == 4, F.concat(w, F.lit("en"))).otherwise(F.concat(F.lit("No"), w))
    return p.select(said.alias("word")).distinct()


@register(f"{_LEX}, {_SURFACE}, {_LEMMAS} SELECT word, row_number() OVER (PARTITION BY word ORDER BY o, pos) AS place, lemma, pos FROM lemma_of")
def lemmatise_in_order(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    return lexicon.lemmas_in_order(surfaces(t), t["entries"], t["forms"]).withColumn("place", F.col("place").cast("long"))


@register(
    f"""{_LEX}, {_SURFACE}, {_LEMMAS}, pl AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY o, pos) AS place, lower(word) AS self FROM lemma_of), it AS (SELECT *, bool_or(lemma = self) OVER (PARTITION BY word) AS itself FROM pl),
kept AS (SELECT word, place, lemma AS key FROM it WHERE NOT itself OR (pos IN ('n', 'v') AND lemma <> self) OR (self, lemma) IN (SELECT (form_key, lemma_key) FROM forms JOIN entries ON id = entry_id) UNION ALL SELECT DISTINCT word, 0, self FROM it WHERE itself
UNION ALL SELECT word, 0, lower(word) FROM surface WHERE word NOT IN (SELECT word FROM lemma_of)), f AS (SELECT word, key, min(place) AS pl FROM kept GROUP BY word, key)
SELECT word, row_number() OVER (PARTITION BY word ORDER BY pl, key) AS place, key FROM f"""
)
def lemma_keys(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    return lexicon.word_keys(surfaces(t), t["entries"], t["forms"]).withColumn("place", F.col("place").cast("long"))


# ---- serving build.  The sample's definitions and examples hold only lemmas, so a token's key is itself.

_GLOSS = f"""stop(key) AS (VALUES {_STOP}),
dtok AS (SELECT id AS synset, unnest(string_split(definition, ' ')) AS key FROM synsets), def AS (SELECT DISTINCT synset, key FROM dtok WHERE key NOT IN (SELECT key FROM stop) AND length(key) >= 2),
ex AS (SELECT DISTINCT synset, key FROM (SELECT synset_id AS synset, unnest(string_split(text, ' ')) AS key FROM examples) WHERE key NOT IN (SELECT key FROM stop) AND length(key) >= 2 AND (synset, key) NOT IN (SELECT (synset, key) FROM def)),
mem AS (SELECT DISTINCT synset_id AS synset, lemma AS key FROM senses),
doc AS (SELECT synset, key FROM def UNION SELECT synset, key FROM ex UNION SELECT synset, key FROM mem UNION SELECT synset, k FROM (SELECT synset, unnest(string_split(key, ' ')) AS k FROM mem) WHERE k NOT IN (SELECT key FROM stop)),
idf AS (SELECT replace(key, ' ', '_') AS key, count(*) AS df, CASE WHEN count(*) > 1 THEN round(ln((any_value(n) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE, 4) ELSE ln((any_value(n) + 1.0::DOUBLE) / 2.0::DOUBLE) + 1.0::DOUBLE END AS idf FROM doc, (SELECT count(*) AS n FROM synsets) GROUP BY key)"""
_LINKS = "links AS (SELECT src, rel, dst, CASE rel WHEN 'hypernym' THEN 0.7::DOUBLE WHEN 'similar' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS w FROM (SELECT src, rel, dst FROM synset_relations WHERE rel <> 'exemplifies' UNION SELECT a.synset_id, rel, b.synset_id FROM sense_relations JOIN senses a ON a.id = src_sense JOIN senses b ON b.id = dst_sense WHERE rel = 'derivation' AND a.synset_id <> b.synset_id)), near60 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, rel ORDER BY dst) AS n FROM links) WHERE n <= 60)"
_SIG = f"""{_LINKS}, put AS (SELECT src AS synset, replace(key, ' ', '_') AS key, w, rel AS how, '0' || rel AS o FROM near60 JOIN mem ON mem.synset = dst UNION ALL SELECT src, unnest(string_split(key, ' ')), w * 0.6::DOUBLE, rel, '0' || rel FROM near60 JOIN mem ON mem.synset = dst WHERE contains(key, ' ')
UNION ALL SELECT src, key, w * 0.6::DOUBLE, rel, '0' || rel FROM near60 JOIN def ON def.synset = dst UNION ALL SELECT src, key, w * 0.3::DOUBLE, rel, '0' || rel FROM near60 JOIN ex ON ex.synset = dst
UNION ALL SELECT synset, key, 1.0::DOUBLE, 'example', '2' FROM ex UNION ALL SELECT synset, key, 1.0::DOUBLE, 'definition', '3' FROM def UNION ALL SELECT synset, replace(key, ' ', '_'), 1.0::DOUBLE, 'synonym', '4' FROM mem UNION ALL SELECT synset, unnest(string_split(key, ' ')), 0.6::DOUBLE, 'synonym', '4' FROM mem WHERE contains(key, ' ')),
sg AS (SELECT synset, key, min((-round(w, 6), o, how)) AS b FROM put WHERE key NOT IN (SELECT key FROM stop) GROUP BY synset, key)"""


@register(f"{_LEX}, {_GLOSS} SELECT key, df, CAST(floor(idf * 10000 + 0.5) AS BIGINT) AS idf4 FROM idf WHERE df > 1")
def gloss_idf(spark, sf_dir):
    t, stop = sample.lexicon(spark, sf_dir), stops(spark)
    d, e, m = serving.glosses(t, stop)
    return serving.frequencies(d, e, m, t["synsets"], stop).filter("df > 1").select("key", "df", F.floor(F.col("idf") * 10000 + 0.5).alias("idf4"))


@register(f"{_LEX}, {_GLOSS}, {_SIG} SELECT synset, key, -b[1] AS w, b[3] AS how FROM sg")
def relation_signature(spark, sf_dir):
    t, stop = sample.lexicon(spark, sf_dir), stops(spark)
    d, e, m = serving.glosses(t, stop)
    links = graph.weighted(t["synset_relations"], t["sense_relations"], t["senses"])
    return features.relation_signature(m.select("synset", "key"), d, e, links, m.select("synset", "key").limit(0), stop)


_FITSENSE = """ent AS (SELECT lemma_key AS key, synset_id AS synset, min((rank, s.lemma, CASE WHEN s.pos = 's' THEN 'a' ELSE s.pos END)) AS e FROM senses s JOIN entries n ON n.id = s.entry_id WHERE synset_id NOT IN (SELECT id FROM unfit) AND lemma_key NOT IN (SELECT key FROM bad) AND len(string_split(lemma_key, ' ')) <= 2 GROUP BY 1, 2)"""


def built(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    unfit, bad = sample.unfit(t)
    return serving.build(t, unfit, bad, stop=stops(spark), lists={"generic": ["door"]}, main=sample.SOURCE)


def shown(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    unfit, bad = sample.unfit(t)
    return t, bad, serving.shown_entries(t, unfit, bad)


@register(f"{_LEX}, {_FITSENSE} SELECT key, e[2] AS lemma, e[3] AS pos, synset, e[1] AS rank FROM ent")
def serving_entry(spark, sf_dir):
    return shown(spark, sf_dir)[2].withColumn("rank", F.col("rank").cast("long"))


@register(f"{_LEX}, {_FITSENSE}, {_GLOSS}, {_SIG} SELECT y.id, CASE WHEN y.pos = 's' THEN 'a' ELSE y.pos END AS pos, definition, text AS example, (SELECT count(*) FROM sg WHERE sg.synset = y.id) AS sigsize FROM synsets y LEFT JOIN examples x ON x.synset_id = y.id WHERE y.id IN (SELECT synset FROM ent)")
def serving_meaning(spark, sf_dir):
    return built(spark, sf_dir)["meaning"].select("id", "pos", "definition", "example", F.col("sigsize").cast("long").alias("sigsize"))


@register(f"{_LEX}, {_FITSENSE} SELECT synset_id AS synset, row_number() OVER (PARTITION BY synset_id ORDER BY lemma) AS ord, lemma AS word FROM senses WHERE synset_id IN (SELECT synset FROM ent) AND lemma NOT IN (SELECT key FROM bad)")
def serving_syn(spark, sf_dir):
    t, bad, entry = shown(spark, sf_dir)
    words = t["senses"].select(F.col("synset_id").alias("synset"), F.col("lemma").alias("word"), F.lit(sample.SOURCE).alias("source"), F.lit(1.0).alias("score"))
    return serving.shown_synonyms(words, entry, bad, sample.SOURCE).select("synset", F.col("ord").cast("long").alias("ord"), "word")


@register(f"{_LEX}, {_FITSENSE} SELECT DISTINCT a.synset_id AS synset, b.lemma AS word FROM sense_relations JOIN senses a ON a.id = src_sense JOIN senses b ON b.id = dst_sense WHERE rel = 'antonym' AND a.synset_id IN (SELECT synset FROM ent) AND b.lemma NOT IN (SELECT key FROM bad)")
def serving_ant(spark, sf_dir):
    t, bad, entry = shown(spark, sf_dir)
    return serving.shown_antonyms(t, entry, bad)


@register(
    f"""{_LEX}, {_FITSENSE}, {_GLOSS}, {_SIG}, v AS (SELECT synset, sg.key, round(-b[1] * idf, 6) AS v FROM sg JOIN idf ON idf.key = sg.key WHERE synset IN (SELECT synset FROM ent))
SELECT synset, key, CAST(round(v * 100) AS BIGINT) AS w FROM (SELECT *, row_number() OVER (PARTITION BY synset ORDER BY v DESC, key DESC) AS place FROM v) WHERE place <= 60 AND v >= 0.05"""
)
def serving_sig(spark, sf_dir):
    t = built(spark, sf_dir)
    return t["sig"].join(t["kw"], "kid").join(t["meaning"].select("mid", F.col("id").alias("synset")), "mid").select("synset", "key", F.col("w").cast("long").alias("w"))


@register(
    f"""{_LEX}, {_FITSENSE}, {_GLOSS}, kin AS (SELECT * FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY rel, dst) AS n FROM synset_relations WHERE rel IN ('hypernym', 'hyponym')) WHERE n <= 25),
part AS (SELECT synset, unnest(string_split(key, ' ')) AS link FROM mem), bag AS (SELECT synset, link, max(w) AS w FROM (SELECT synset, key AS link, 1.0::DOUBLE AS w FROM def UNION ALL SELECT synset, link, 1.0 FROM part UNION ALL SELECT src, link, 0.6 FROM kin JOIN part ON part.synset = dst UNION ALL SELECT src, key, 0.4 FROM kin JOIN def ON def.synset = dst) GROUP BY 1, 2),
se AS (SELECT key, synset, 1.0::DOUBLE / (1.0::DOUBLE + 0.15::DOUBLE * (e[1] - 1)) AS wt FROM ent WHERE NOT contains(key, ' ') AND key NOT IN (SELECT key FROM stop) AND key <> 'door' AND e[1] <= 40), tot AS (SELECT key, sum(wt) AS total FROM se GROUP BY key),
mean AS (SELECT se.key, link, round(sum(w * wt) / any_value(total), 9) AS mean FROM se JOIN bag USING (synset) JOIN tot USING (key) GROUP BY 1, 2),
kept AS (SELECT mean.* FROM mean JOIN idf ON idf.key = link WHERE idf >= 4.5 AND link <> mean.key AND link NOT IN (SELECT key FROM stop) AND link <> 'door')
SELECT key, link, w, place FROM (SELECT key, link, CAST(floor(mean * 100 + 0.5) AS BIGINT) AS w, row_number() OVER (PARTITION BY key ORDER BY mean DESC, link) AS place FROM kept) WHERE place <= 40 AND w > 0"""
)
def serving_exp(spark, sf_dir):
    t, _, entry = shown(spark, sf_dir)
    stop = stops(spark)
    d, e, m = serving.glosses(t, stop)
    idf = serving.frequencies(d, e, m, t["synsets"], stop)
    generic = spark.range(1).select(F.lit("door").alias("key"))
    out = serving.clue_links(entry, features.bags(m, d, t["synset_relations"]), idf, stop, generic)
    return out.select("key", "link", F.col("w").cast("long").alias("w"), F.col("place").cast("long").alias("place"))


@register(f"{_LEX}, {_FITSENSE} SELECT DISTINCT ent.key, reverse(ent.key) AS ipa FROM ent WHERE NOT contains(ent.key, ' ')")
def serving_ipa(spark, sf_dir):
    t, _, entry = shown(spark, sf_dir)
    return serving.pronunciations(entry, t)


@register("SELECT * FROM (VALUES ('clue_share', '0.12'), ('dist_decay', '0.04'), ('indirect', '0.35'), ('indirect_max', '2.0'), ('min_clue', '0.8'), ('pos_bonus', '4.0'), ('pos_other', '0.5'), ('prior', '2.0'), ('schema_version', '1'), ('sig_ref', '150'), ('words_generic', 'door')) t(key, value)")
def serving_meta(spark, sf_dir):
    return serving.meta_table(spark, {"generic": ["door"]})


# ---- alignment of old books to the sample lexicon

def book_base(spark, sf_dir):
    t, stop = sample.lexicon(spark, sf_dir), stops(spark)
    d, _, _ = serving.glosses(t, stop)
    return assembly.base(t, stop, d, sample.unfit(t)[1])


def book_records(spark, sf_dir):
    """One record per part: its word, and as synonyms its name, the word of a similar part and the name of its hypernym."""
    t = sample.lexicon(spark, sf_dir)
    w = t["senses"].filter("member_rank = 1").select(F.substring("synset_id", 2, 20).cast("long").alias("k"), F.col("lemma").alias("word"), graph.folded(F.col("pos")).alias("pos"), "synset_id")
    w = w.join(t["senses"].filter("member_rank = 2").select("synset_id", F.col("lemma").alias("name")), "synset_id").drop("synset_id")
    near = w.select((F.col("k") + 1).alias("k"), F.col("word").alias("near"))
    up = w.select(F.col("k").alias("up_k"), F.col("name").alias("up"))
    rows = w.join(near, "k", "left").join(up, F.floor(F.col("k") / 10) == F.col("up_k"), "left")
    pos = F.when(F.col("k") % 17 == 0, "prep").when(F.col("k") % 19 == 0, None).when(F.col("pos") == "a", "adj").otherwise(F.col("pos"))
    labels = F.when(F.col("k") % 23 == 0, F.array(F.lit("Low."))).otherwise(F.array().cast("array<string>"))
    sense = F.struct(F.lit(1).alias("n"), F.array_distinct(F.array_compact(F.array("name", "near", "up"))).alias("synonyms"), labels.alias("labels"))
    return rows.select(F.col("word").alias("headword"), pos.alias("pos"), F.array(sense).alias("senses"), F.col("k").alias("line"))


_HOOD = f"""mkey AS (SELECT DISTINCT synset_id AS synset, lemma AS key FROM senses), full_ AS (SELECT synset, key, 1.0::DOUBLE AS w FROM mkey UNION ALL SELECT src, key, CASE rel WHEN 'hyponym' THEN 0.4::DOUBLE WHEN 'hypernym' THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END FROM synset_relations JOIN mkey ON mkey.synset = dst WHERE rel IN ('hyponym', 'hypernym', 'also', 'similar')),
hood AS (SELECT synset, key, max(w) AS w FROM (SELECT * FROM full_ UNION ALL SELECT synset, part, w * 0.5::DOUBLE FROM (SELECT synset, unnest(string_split(key, ' ')) AS part, w FROM full_ WHERE contains(key, ' ')) WHERE part NOT IN (SELECT key FROM stop) UNION ALL SELECT synset, key, 0.5::DOUBLE FROM def) GROUP BY 1, 2)"""
_ALIGN = f"""rec AS (SELECT a.k, a.word AS head, CASE WHEN a.k % 17 = 0 THEN 'prep' WHEN a.k % 19 = 0 THEN NULL WHEN a.pos IN ('a', 's') THEN 'adj' ELSE a.pos END AS bpos, list_distinct(list_filter([a.name, n.word, u.name], lambda x: x IS NOT NULL)) AS words, a.k % 23 = 0 AS low FROM p a LEFT JOIN p n ON n.k = a.k - 1 LEFT JOIN p u ON u.k = a.k // 10),
fitrec AS (SELECT *, CASE bpos WHEN 'adj' THEN 'a' ELSE bpos END AS pos FROM rec WHERE NOT low AND (bpos IS NULL OR bpos <> 'prep')), w AS (SELECT DISTINCT k, head, pos, unnest(words) AS word FROM fitrec),
cnt AS (SELECT k, count(DISTINCT word) AS n FROM w WHERE word NOT IN (SELECT key FROM bad) AND word <> head GROUP BY k),
cand AS (SELECT f.k, f.head, s.synset_id AS target, row_number() OVER (PARTITION BY f.k ORDER BY (CASE e.pos WHEN 'n' THEN 0 WHEN 'v' THEN 1 ELSE 2 END), e.id, s.rank) AS ord FROM fitrec f JOIN entries e ON e.lemma_key = f.head AND (f.pos IS NULL OR f.pos = CASE WHEN e.pos = 's' THEN 'a' ELSE e.pos END) JOIN senses s ON s.entry_id = e.id WHERE f.k IN (SELECT k FROM cnt)),
hits AS (SELECT c.k, c.target, c.ord, w.word, max(CASE WHEN h.key = w.word THEN h.w END) AS exact, max(CASE WHEN h.key <> w.word THEN h.w * 0.5::DOUBLE END) AS part FROM cand c JOIN w ON w.k = c.k AND w.word <> c.head JOIN hood h ON h.synset = c.target AND h.key <> c.head AND (h.key = w.word OR (contains(w.word, ' ') AND list_contains(string_split(w.word, ' '), h.key))) GROUP BY 1, 2, 3, 4),
sc AS (SELECT c.k, c.target, c.ord, round(coalesce(sum(coalesce(exact, part)), 0), 6) AS part FROM cand c LEFT JOIN hits USING (k, target, ord) GROUP BY 1, 2, 3),
rk AS (SELECT *, round(part, 4) AS score, row_number() OVER (PARTITION BY k ORDER BY round(part, 4) DESC, ord) AS place FROM sc),
ver AS (SELECT b.k, any_value(b.target) AS target, any_value(b.score) AS score, coalesce(max(CASE WHEN r.place = 2 THEN r.score END), 0) AS second, CASE WHEN any_value(b.score) < 1.0 OR any_value(b.part) < 0.4::DOUBLE THEN 'below_threshold' WHEN bool_or(r.place > 1 AND (b.score - r.score < 0.2::DOUBLE OR (r.ord < b.ord AND b.score < 1.5::DOUBLE * r.score))) THEN 'tie' ELSE 'aligned' END AS verdict FROM rk b JOIN rk r ON r.k = b.k WHERE b.place = 1 GROUP BY b.k)"""


@register(f"{_LEX}, {_GLOSS}, {_HOOD} SELECT synset, key, w FROM hood")
def meaning_hoods(spark, sf_dir):
    return book_base(spark, sf_dir).hood


@register(f"{_LEX}, {_GLOSS}, {_HOOD}, {_ALIGN} SELECT ver.k || '#1' AS ref, head AS headword, target AS synset, score, second, n AS n_words FROM ver JOIN rec USING (k) JOIN cnt USING (k) WHERE verdict = 'aligned'")
def align_synonym_book(spark, sf_dir):
    return assembly.align_synonyms(book_base(spark, sf_dir), book_records(spark, sf_dir), "old")["alignments"].drop("source")


@register(
    f"""{_LEX}, {_GLOSS}, {_HOOD}, {_ALIGN} SELECT ver.k || '#1' AS ref, head AS headword, bpos AS pos, verdict AS reason, target AS best, score FROM ver JOIN rec USING (k) WHERE verdict <> 'aligned'
UNION ALL SELECT k || '#1', head, bpos, 'unsupported_pos', NULL, NULL FROM rec WHERE bpos = 'prep'"""
)
def unaligned_audit(spark, sf_dir):
    return assembly.align_synonyms(book_base(spark, sf_dir), book_records(spark, sf_dir), "old")["unaligned"].select("ref", "headword", "pos", "reason", "best", "score")


_BOOKSYN = f"""bs AS (SELECT target AS synset, word, max(score) AS score FROM ver JOIN w USING (k) JOIN synsets y ON y.id = target WHERE verdict = 'aligned' AND word <> head AND word NOT IN (SELECT key FROM bad) AND (contains(word, ' ') OR (word, CASE WHEN y.pos = 's' THEN 'a' ELSE y.pos END) IN (SELECT (lemma_key, CASE WHEN pos = 's' THEN 'a' ELSE pos END) FROM entries)) GROUP BY 1, 2)"""


@register(
    f"""{_LEX}, {_GLOSS}, {_HOOD}, {_ALIGN}, {_BOOKSYN} SELECT DISTINCT synset_id AS synset, lemma AS word, lemma AS key, 'base' AS source, 1.0::DOUBLE AS score FROM senses WHERE synset_id NOT IN (SELECT id FROM unfit) AND lemma NOT IN (SELECT key FROM bad)
UNION ALL SELECT synset, word, word, 'old', score FROM bs WHERE synset NOT IN (SELECT id FROM unfit)"""
)
def integrated_synonyms(spark, sf_dir):
    b = book_base(spark, sf_dir)
    unfit, bad = sample.unfit(b.lexicon)
    book = assembly.align_synonyms(b, book_records(spark, sf_dir), "old")["synonyms"]
    return assembly.assemble(b, unfit.withColumn("reason", F.lit("offensive")), bad, [book], sample.SOURCE)["sense_synonyms"]


@register(f"{_LEX} SELECT 'synset' AS kind, id AS key, 'offensive' AS reason FROM unfit UNION ALL SELECT 'word', key, 'blocklist' FROM bad")
def children_filter(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    unfit, bad = sample.unfit(t)
    b = assembly.Base(t, stops(spark), t["synsets"], bad)
    return assembly.assemble(b, unfit.withColumn("reason", F.lit("offensive")), bad, [], sample.SOURCE)["kid_filter"]


# ---- the picker over generated sentences

_SAID = "said AS (SELECT p.k AS qid, p.word AS target, 'zz saw ' || p.word || ' near ' || coalesce(n.name, 'nothing') || ' and ' || coalesce(u.word, 'less') || ' zz' AS sentence FROM p LEFT JOIN p n ON n.k = p.k + 1 LEFT JOIN p u ON u.k = p.k // 10)"


def sentences(spark, sf_dir):
    """One sentence per part, about its word, the name of the next part and the word of its hypernym."""
    t = sample.lexicon(spark, sf_dir)
    w = t["senses"].filter("member_rank = 1").select(F.substring("synset_id", 2, 20).cast("long").alias("k"), F.col("lemma").alias("word"))
    name = t["senses"].filter("member_rank = 2").select((F.substring("synset_id", 2, 20).cast("long") - 1).alias("k"), F.col("lemma").alias("name"))
    up = w.select(F.col("k").alias("up"), F.col("word").alias("up_word"))
    rows = w.join(name, "k", "left").join(up, F.floor(F.col("k") / 10) == F.col("up"), "left")
    said = F.concat(F.lit("zz saw "), "word", F.lit(" near "), F.coalesce("name", F.lit("nothing")), F.lit(" and "), F.coalesce("up_word", F.lit("less")), F.lit(" zz"))
    return rows.select(F.col("k").alias("qid"), said.alias("sentence"), F.col("word").alias("target"), F.lit(None).cast("int").alias("at"))


@register(
    f"""{_LEX}, {_FITSENSE}, {_GLOSS}, {_SIG}, {_SAID},
v AS (SELECT synset, sg.key, round(-b[1] * idf, 6) AS v FROM sg JOIN idf ON idf.key = sg.key WHERE synset IN (SELECT synset FROM ent)),
sig_ AS (SELECT synset, key, CAST(round(v * 100) AS BIGINT) / 100.0::DOUBLE AS w, size FROM (SELECT *, row_number() OVER (PARTITION BY synset ORDER BY v DESC, key DESC) AS place, count(*) OVER (PARTITION BY synset) AS size FROM v) WHERE place <= 60 AND v >= 0.05),
kin AS (SELECT * FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY rel, dst) AS n FROM synset_relations WHERE rel IN ('hypernym', 'hyponym')) WHERE n <= 25), part AS (SELECT synset, unnest(string_split(key, ' ')) AS link FROM mem),
bag AS (SELECT synset, link, max(w) AS w FROM (SELECT synset, key AS link, 1.0::DOUBLE AS w FROM def UNION ALL SELECT synset, link, 1.0 FROM part UNION ALL SELECT src, link, 0.6 FROM kin JOIN part ON part.synset = dst UNION ALL SELECT src, key, 0.4 FROM kin JOIN def ON def.synset = dst) GROUP BY 1, 2),
se AS (SELECT key, synset, 1.0::DOUBLE / (1.0::DOUBLE + 0.15::DOUBLE * (e[1] - 1)) AS wt FROM ent WHERE NOT contains(key, ' ') AND key NOT IN (SELECT key FROM stop) AND key <> 'door' AND e[1] <= 40), tot AS (SELECT key, sum(wt) AS total FROM se GROUP BY key),
mean AS (SELECT se.key, link, round(sum(w * wt) / any_value(total), 9) AS mean FROM se JOIN bag USING (synset) JOIN tot USING (key) GROUP BY 1, 2),
exp_ AS (SELECT key, link, w / 100.0::DOUBLE AS lw FROM (SELECT mean.key, link, floor(mean * 100 + 0.5) AS w, row_number() OVER (PARTITION BY mean.key ORDER BY mean DESC, link) AS place FROM mean JOIN idf ON idf.key = link WHERE idf >= 4.5 AND link <> mean.key AND link NOT IN (SELECT key FROM stop) AND link <> 'door') WHERE place <= 40 AND w > 0),
tk AS (SELECT qid, target, unnest(string_split(sentence, ' ')) AS low, unnest(range(len(string_split(sentence, ' ')))) AS j FROM said),
clue AS (SELECT qid, low AS key, 1.0::DOUBLE / (1.0::DOUBLE + 0.04::DOUBLE * greatest(min(abs(j - 2)) - 1, 0)) AS dw FROM tk WHERE low <> target AND low NOT IN (SELECT key FROM stop) GROUP BY qid, low),
cnd AS (SELECT qid, synset, e[1] AS rank FROM said JOIN ent ON ent.key = target),
pts AS (SELECT c.qid, c.synset, u.key, u.dw, max(s.w) AS direct, (SELECT CASE WHEN count(*) > 0 THEN least(0.35::DOUBLE * sum(s2.w * x.lw) * least(1.0::DOUBLE, sqrt(150.0::DOUBLE / max(s2.size))), 2.0::DOUBLE) END FROM exp_ x JOIN sig_ s2 ON s2.key = x.link WHERE x.key = u.key AND s2.synset = c.synset) AS indirect
 FROM cnd c JOIN clue u ON u.qid = c.qid LEFT JOIN sig_ s ON s.synset = c.synset AND s.key = u.key GROUP BY c.qid, c.synset, u.key, u.dw),
tt AS (SELECT qid, synset, sum(greatest(coalesce(direct, 0), coalesce(indirect, 0)) * dw) AS total FROM pts GROUP BY 1, 2),
fin AS (SELECT c.qid, c.synset, rank, round(coalesce(total, 0) + 2.0::DOUBLE / rank, 6) AS score FROM cnd c LEFT JOIN tt USING (qid, synset))
SELECT qid, synset, CAST(floor(round(score, 3) * 100 + 0.5) AS BIGINT) AS score2 FROM fin WHERE true QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 3) DESC, rank, synset) = 1"""
)
def picker_sentences(spark, sf_dir):
    asked = sentences(spark, sf_dir)
    tables = built(spark, sf_dir)
    best = picker.pick(asked, tables, {"generic": ["door"]}).filter("place = 1")
    return best.select("qid", "synset", F.floor(F.col("score") * 100 + 0.5).alias("score2"))


_ASKED = "asked AS (SELECT k AS qid, CASE k % 4 WHEN 0 THEN word || ', ' || name || ' and ' || word WHEN 1 THEN name || ' by the ' || word || 's' WHEN 2 THEN 'so ' || word || ' it is; ' || word ELSE 'nothing here' END AS sentence, '(' || word || ')' AS target, word, CASE WHEN k % 3 = 0 THEN length(word) + 2 WHEN k % 3 = 1 THEN 200 END AS tap FROM p)"


@register(
    rf"""{_LEX}, {_ASKED}, g AS (SELECT qid, word, tap, unnest(regexp_extract_all(sentence, '[a-z]+')) AS low, unnest(range(len(regexp_extract_all(sentence, '[a-z]+')))) AS j, unnest(regexp_extract_all(sentence || ' ', '[a-z]+[^a-z]*')) AS whole FROM asked),
o AS (SELECT *, coalesce(sum(length(whole)) OVER (PARTITION BY qid ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM g),
r AS (SELECT qid, j, low, CASE WHEN tap >= start AND tap < start + length(low) THEN 0 WHEN low = word THEN 1 WHEN low = word || 's' AND word IN (SELECT lemma FROM entries WHERE pos IN ('n', 'v')) THEN 2 END AS way, coalesce(abs(start - tap), 0) AS far FROM o),
m AS (SELECT qid, min((way, far, j, low)) AS m FROM r WHERE way IS NOT NULL GROUP BY qid)
SELECT asked.qid, CAST(m.m[3] AS BIGINT) AS ti, coalesce(m.m[4], asked.word) AS low FROM asked LEFT JOIN m ON m.qid = asked.qid"""
)
def find_target(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    w = t["senses"].filter("member_rank = 1").select(F.substring("synset_id", 2, 20).cast("long").alias("k"), F.col("lemma").alias("word"), "synset_id")
    w = w.join(t["senses"].filter("member_rank = 2").select("synset_id", F.col("lemma").alias("name")), "synset_id")
    k, word, name = F.col("k"), F.col("word"), F.col("name")
    said = F.when(k % 4 == 0, F.concat(word, F.lit(", "), name, F.lit(" and "), word)).when(k % 4 == 1, F.concat(name, F.lit(" by the "), word, F.lit("s"))).when(k % 4 == 2, F.concat(F.lit("so "), word, F.lit(" it is; "), word)).otherwise("nothing here")
    at = F.when(k % 3 == 0, F.length(word) + 2).when(k % 3 == 1, 200)
    asked = w.select(k.alias("qid"), said.alias("sentence"), F.concat(F.lit("("), word, F.lit(")")).alias("target"), at.alias("at"))
    entry = t["entries"].select(F.col("lemma_key").alias("key"), graph.folded(F.col("pos")).alias("pos")).distinct()
    plural = t["entries"].filter("pos in ('n', 'v') and lemma not like '% %'").select(F.concat("lemma", F.lit("s")).alias("form"), F.col("lemma").alias("key"), F.lit(1).alias("ord")).distinct()
    found = picker.find_target(asked, picker.sentence_tokens(asked), plural, entry)
    return found.select("qid", F.col("ti").cast("long").alias("ti"), "low")


@register(
    f"""{_LEX}, q AS (SELECT k AS qid, word, CASE WHEN pos = 's' THEN 'a' ELSE pos END AS pos, right(word, 1) AS z FROM p),
f AS (SELECT qid, word AS form FROM q UNION SELECT qid, unnest(CASE WHEN pos IN ('n', 'v') THEN [word || 's', word || 'es', word || '''s'] ELSE [word || 'er', word || 'est', word || 'r', word || 'st', word || z || 'er', word || z || 'est'] END) FROM q
UNION SELECT qid, unnest([word || 'ed', word || 'd', word || 'ing', word || z || 'ed', word || z || 'ing']) FROM q WHERE pos = 'v' UNION SELECT qid, left(word, length(word) - 1) || 'ing' FROM q WHERE pos = 'v' AND z = 'e' UNION SELECT qid, form_key FROM q JOIN forms ON form_key = word || 'en') SELECT qid, form FROM f"""
)
def target_forms(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    own = t["senses"].filter("member_rank = 1").select(F.substring("synset_id", 2, 20).cast("long").alias("qid"), F.col("lemma").alias("low"), F.col("lemma").alias("key"), graph.folded(F.col("pos")).alias("pos"))
    forms = t["forms"].join(t["entries"].select(F.col("id").alias("entry_id"), F.col("lemma_key").alias("key")), "entry_id").select("key", F.col("form_key").alias("form"))
    return picker.target_forms(own, forms)


# ---- search, evaluation, stores

@register(
    f"""WITH v AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part), q AS (SELECT DISTINCT left(word, n) AS query FROM v, (VALUES (1), (2), (5)) t(n))
SELECT query, word AS key, place FROM (SELECT query, word, row_number() OVER (PARTITION BY query ORDER BY length(word), word) AS place FROM q JOIN v ON starts_with(word, query)) WHERE place <= 8"""
)
def completions_of_any_length(spark, sf_dir):
    v = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("key")).distinct()
    q = v.select(F.explode(F.array(*[F.left("key", F.lit(n)) for n in (1, 2, 5)])).alias("query"))
    return search.completions(q, v).withColumn("place", F.col("place").cast("long"))


@register(f"{_LEX}, {_FITSENSE}, w AS (SELECT DISTINCT CASE k % 3 WHEN 0 THEN upper(word) WHEN 1 THEN name ELSE 'zz' || word END AS word FROM p) SELECT w.word, lower(w.word) AS key, count(ent.key) > 0 AS found, count(ent.key) AS meanings, CASE WHEN count(ent.key) > 0 AND NOT contains(w.word, ' ') THEN reverse(lower(w.word)) END AS said FROM w LEFT JOIN ent ON ent.key = lower(w.word) GROUP BY w.word")
def point_lookups(spark, sf_dir):
    t, _, entry = shown(spark, sf_dir)
    w = t["senses"].filter("member_rank = 1").select(F.substring("synset_id", 2, 20).cast("long").alias("k"), F.col("lemma").alias("word"), "synset_id").join(t["senses"].filter("member_rank = 2").select("synset_id", F.col("lemma").alias("name")), "synset_id")
    asked = w.select(F.when(F.col("k") % 3 == 0, F.upper("word")).when(F.col("k") % 3 == 1, F.col("name")).otherwise(F.concat(F.lit("zz"), "word")).alias("word"))
    return search.look_up(asked, {"entry": entry, "ipa": serving.pronunciations(entry, t)})


@register(
    """WITH r AS (SELECT event_type AS kind, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
q AS (SELECT kind, any_value(n) AS n, CAST(floor(1e4 * avg(x) + 0.5) AS BIGINT) AS mean4, max(x) AS top FROM r GROUP BY kind),
c AS (SELECT kind, parts, qn, greatest(1, least((n + 1) * qn // parts, n - 1)) AS j, n FROM q, (VALUES (1, 2), (9, 10)) t(qn, parts)),
v AS (SELECT c.kind, parts, (max(CASE WHEN r.r = j THEN x END) * (parts - (any_value(c.n) * any_value(qn) + any_value(qn) - any_value(j) * parts)) + max(CASE WHEN r.r = j + 1 THEN x END) * (any_value(c.n) * any_value(qn) + any_value(qn) - any_value(j) * parts)) / parts AS value FROM c JOIN r ON r.kind = c.kind GROUP BY c.kind, parts)
SELECT kind, n, mean4, max(CASE WHEN parts = 2 THEN value END) AS median, max(CASE WHEN parts = 10 THEN value END) AS p90, top FROM q JOIN v USING (kind) GROUP BY kind, n, mean4, top"""
)
def latency_summary(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "value")
    out = evaluate.summary(own, ["kind"], "value")
    return out.select("kind", "n", F.floor(F.col("mean") * 1e4 + 0.5).alias("mean4"), "median", "p90", "top")


@register("SELECT conv_id, turn, role FROM conversations WHERE role NOT IN (SELECT role FROM conversations WHERE conv_id = 0)")
def unseen_items(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return evaluate.unseen(c, c.filter("conv_id = 0"), "role").select("conv_id", "turn", "role")


@register("SELECT source, count(DISTINCT doc_id) FILTER (n_chars > 1000) AS long_docs, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS english, CAST(sum(CASE WHEN n_chars <= 100 THEN 1 ELSE 0 END) AS BIGINT) AS tiny FROM documents GROUP BY source")
def conditional_counters(spark, sf_dir):
    when = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct(F.when(F.col("n_chars") > 1000, F.col("doc_id"))).alias("long_docs"), when(F.col("lang") == "en").alias("english"), when(F.col("n_chars") <= 100).alias("tiny"))


@register("SELECT user_id, place, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 3")
def newest_first(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(by).cast("long").alias("place"), "event_id").filter("place <= 3")


@register(
    """WITH a AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey % 2 = 0), n AS (SELECT * FROM a UNION ALL SELECT n_nationkey, 'new ' || n_name FROM nation WHERE n_nationkey NOT IN (SELECT k FROM a)),
r AS (SELECT k, v FROM n WHERE k % 5 <> 0 UNION ALL SELECT n_nationkey, 'again ' || n_name FROM nation WHERE n_nationkey % 5 = 0), m AS (SELECT 'rows_nation' AS k, CAST(count(*) AS VARCHAR) AS v FROM r UNION ALL SELECT 'layer', 'x')
SELECT 'nation' AS name, CAST(k AS VARCHAR) AS key, v AS value FROM r UNION ALL SELECT 'meta', k, v FROM m UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region"""
)
def catalog_build(spark, sf_dir):
    """A catalog built twice (the second build takes a layer of the first and changes it), read back."""
    home = f"{scratch.folder(spark).rstrip('/')}/catalog-{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "nation")
    first = n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    stores.build(spark, home, {"nation": first, "region": table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))})
    more = n.select(F.col("n_nationkey").alias("k"), F.concat(F.lit("new "), "n_name").alias("v"))
    again = n.filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("again "), "n_name").alias("v"))
    own = stores.replace_rows(stores.insert_new(stores.open_table(spark, home, "nation"), more, ["k"]), again, ["k"])
    tables = {"nation": own, **stores.copy_layer(spark, home, ["region"])}
    tables["meta"] = stores.metadata({"nation": own}, {"layer": "x"}).select(F.col("key").alias("k"), F.col("value").alias("v"))
    stores.build(spark, home, tables, lambda fresh: stores.guard(stores.open_table(spark, fresh, "nation"), "forbidden").count())
    read = [stores.open_table(spark, home, name).select(F.lit(name).alias("name"), F.col("k").cast("string").alias("key"), F.col("v").alias("value")) for name in ("nation", "region", "meta")]
    return read[0].union(read[1]).union(read[2])


@register("SELECT page_id, octet_length(encode(html)) + 1 AS bytes, sha256(html || chr(10)) AS sha256 FROM pages WHERE html IS NOT NULL")
def file_checksums(spark, sf_dir):
    """Checksums of files: every page written as a file of its own (with a line end), read back as bytes."""
    home = f"{scratch.folder(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
    own = table(spark, sf_dir, "pages").filter("html is not null")
    own.select("page_id", F.col("html").alias("value")).repartition(4, "page_id").write.partitionBy("page_id").text(home)
    found = stores.checksums(spark, f"{home}/*/*.txt")
    return found.select(F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long").alias("page_id"), "bytes", "sha256")


@register(
    """WITH x AS (SELECT lang AS kind, doc_id AS id, 0 AS line, source AS text FROM documents WHERE n_chars < 500)
SELECT kind, count(*) AS n, string_agg(text, '|' ORDER BY id) FILTER (nth <= 8) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id, line, text) AS nth FROM x) GROUP BY kind"""
)
def parse_log(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("n_chars < 500").select(F.col("lang").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).alias("line"), F.col("source").alias("text"))
    return stores.parse_log(rows).select("kind", "n", F.array_join("examples", "|").alias("examples"))


# ---- books made from the part table: written as their printers would, read back

@register(
    """WITH b AS (SELECT p_partkey AS k, lower(p_name) AS name, lower(p_type) AS kind, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS id FROM part WHERE p_name IS NOT NULL),
e AS (SELECT *, 3 * (row_number() OVER (PARTITION BY id ORDER BY k) - 1) AS line, string_split(name, ' ')[2] || chr(CAST(97 + k % 13 AS INT)) AS head, string_split(name, ' ')[1] AS w1 FROM b)
SELECT id, head AS headword, CASE k % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'v' ELSE 'adj' END AS pos, CASE k % 3 WHEN 0 THEN 'n.' WHEN 1 THEN 'v. a.' ELSE 'a.' END AS pos_raw, line,
 '1:' || name || ',' || kind || ';x:' || kind || ';l:Naut.|2:be ' || w1 || ',be thing,be done;x:;l:' AS senses FROM e"""
)
def synonym_book_round_trip(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_name is not null").select(F.col("p_partkey").alias("k"), F.lower("p_name").alias("name"), F.upper("p_type").alias("kind"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("id"))
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("k")) - 1)
    words = F.split("name", " ")
    head = F.initcap(F.concat(F.get(words, F.lit(1)), F.substring(F.lit("abcdefghijklm"), (F.col("k") % 13 + 1).cast("int"), 1)))
    tag = F.element_at(F.array(F.lit("_n._"), F.lit("_v. a._"), F.lit("_a._")), (F.col("k") % 3 + 1).cast("int"))
    said = F.concat(F.lit("~"), head, F.lit("~, "), tag, F.lit(" ~1.~ ("), F.lit("_Naut._) "), F.col("name"), F.lit("; "), F.col("kind"), F.lit("."))
    more = F.concat(F.lit("~2.~ Be "), F.get(words, F.lit(0)), F.lit(", thing, or done."))
    rows = p.select("id", F.explode(F.array(F.struct((F.col("n") * 3).alias("line"), said.alias("text")), F.struct((F.col("n") * 3 + 1).alias("line"), more.alias("text")), F.struct((F.col("n") * 3 + 2).alias("line"), F.lit("").alias("text")))).alias("r")).select("id", "r.*")
    found = synonymy.records(rows, "old")
    sense = lambda s: F.concat(s["n"].cast("string"), F.lit(":"), F.array_join(s["synonyms"], ","), F.lit(";x:"), F.array_join(s["xrefs"], ","), F.lit(";l:"), F.array_join(s["labels"], ","))
    return found.select("id", "headword", "pos", "pos_raw", F.col("line").cast("long").alias("line"), F.array_join(F.transform("senses", sense), "|").alias("senses"))


@register(
    """WITH b AS (SELECT p_partkey AS k, lower(p_name) AS name, lower(p_type) AS kind, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS id FROM part WHERE p_name IS NOT NULL),
e AS (SELECT *, 2 * (row_number() OVER (PARTITION BY id ORDER BY k) - 1) + 4 AS line, CAST(k % 900 + 1 AS VARCHAR) AS ref, string_split(name, ' ')[1] AS w1, string_split(name, ' ')[2] AS w2 FROM b),
g AS (SELECT *, 0 AS place, 'n' AS pos, 0 AS para, w1 || ',' || w2 || chr(CAST(97 + k % 13 AS INT)) AS words, '' AS foreign_, '' AS xrefs FROM e UNION ALL SELECT *, 1, 'n', 0, kind, '', kind || '>' || ref FROM e UNION ALL SELECT *, 2, 'n', 1, name, w2 || 'um', '' FROM e UNION ALL SELECT *, 3, 'v', 0, w1 || ' up', '', '' FROM e)
SELECT id, CAST(k AS VARCHAR) AS head, 'Words about ' || id AS "class", upper(left(kind, 1)) || substr(kind, 2) || ' ' || w1 AS name, line, CAST(place AS BIGINT) AS place, pos, CAST(para AS BIGINT) AS para, words, foreign_ AS "foreign", xrefs FROM g"""
)
def thesaurus_round_trip(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_name is not null").select(F.col("p_partkey").alias("k"), F.lower("p_name").alias("name"), F.lower("p_type").alias("kind"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("id"))
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("k")) - 1)
    w1, w2 = F.get(F.split("name", " "), F.lit(0)), F.get(F.split("name", " "), F.lit(1))
    letter = F.substring(F.lit("abcdefghijklm"), (F.col("k") % 13 + 1).cast("int"), 1)
    ref = (F.col("k") % 900 + 1).cast("string")
    said = F.concat(F.lit("#"), F.col("k").cast("string"), F.lit(". "), F.col("kind"), F.lit(" "), w1, F.lit(".—N. "), w1, F.lit(", "), w2, letter, F.lit("; "), F.col("kind"), F.lit(" &c. "), ref, F.lit(". "), F.col("name"), F.lit(", "), w2, F.lit("um[Lat]. V. "), w1, F.lit(" up."))
    top = p.select("id").distinct().select("id", F.explode(F.array(F.struct(F.lit(0).alias("line"), F.lit("CLASS I").alias("text")), F.struct(F.lit(1).alias("line"), F.concat(F.lit("WORDS ABOUT "), F.col("id").cast("string")).alias("text")), F.struct(F.lit(2).alias("line"), F.lit("").alias("text")))).alias("r")).select("id", "r.*")
    rows = p.select("id", F.explode(F.array(F.struct((F.col("n") * 2 + 4).alias("line"), said.alias("text")), F.struct((F.col("n") * 2 + 5).alias("line"), F.lit("").alias("text")))).alias("r")).select("id", "r.*")
    found = thesaurus.heads(top.union(rows), "old")
    g = found.select("id", "head", "class", "name", "line", F.posexplode("groups").alias("place", "g"))
    refs = F.array_join(F.transform("g.xrefs", lambda x: F.concat(x["word"], F.lit(">"), x["head"])), ",")
    return g.select("id", "head", "class", "name", F.col("line").cast("long").alias("line"), F.col("place").cast("long").alias("place"), "g.pos", F.col("g.para").cast("long").alias("para"), F.array_join("g.words", ",").alias("words"), F.array_join("g.foreign", ",").alias("foreign"), refs.alias("xrefs"))


# ---- the word screen

_ANT = "ant AS (SELECT src_sense AS ref, dst_sense, lemma, synset_id FROM sense_relations JOIN senses ON id = dst_sense WHERE rel = 'antonym'), far AS (SELECT s.id AS ref, ant.dst_sense, ant.lemma, ant.synset_id FROM senses s JOIN synset_relations r ON r.src = s.synset_id AND r.rel = 'similar' JOIN synsets h ON h.id = r.dst AND h.pos = 'a' JOIN senses hs ON hs.synset_id = h.id JOIN ant ON ant.ref = hs.id WHERE s.id NOT IN (SELECT ref FROM ant)), opp AS (SELECT ref, lemma, min(dst_sense) AS o FROM (SELECT * FROM ant UNION ALL SELECT * FROM far) WHERE lemma NOT IN (SELECT key FROM bad) AND synset_id NOT IN (SELECT id FROM unfit) GROUP BY 1, 2)"


@register(
    f"""{_LEX}, {_ANT}, q AS (SELECT word, min(k) AS qid FROM p WHERE k % 4 = 0 GROUP BY word UNION ALL SELECT 'zz', -1),
m AS (SELECT qid, q.word, s.synset_id AS synset, min((CASE e.pos WHEN 'n' THEN 0 WHEN 'v' THEN 1 ELSE 2 END, e.id, s.rank)) AS o FROM q JOIN entries e ON e.lemma_key = q.word JOIN senses s ON s.entry_id = e.id WHERE s.synset_id NOT IN (SELECT id FROM unfit) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) AS place, count(*) OVER (PARTITION BY qid) AS n FROM m),
f AS (SELECT r.src AS synset, a.word AS lemma, s.lemma AS key, min((CASE r.rel WHEN 'hyponym' THEN 0 ELSE 1 END, r.dst)) AS o FROM synset_relations r JOIN p a ON 'y' || a.k = r.src JOIN senses s ON s.synset_id = r.dst AND s.member_rank = 1
 WHERE r.rel IN ('hyponym', 'hypernym') AND r.dst NOT IN (SELECT id FROM unfit) AND s.lemma NOT IN (SELECT key FROM bad) AND s.lemma <> a.word GROUP BY 1, 2, 3),
k4 AS (SELECT synset, string_agg(key, ',' ORDER BY o) AS related FROM (SELECT *, row_number() OVER (PARTITION BY synset ORDER BY o) AS n FROM f) WHERE n <= 4 GROUP BY synset),
a4 AS (SELECT ref, string_agg(lemma, ',' ORDER BY o) AS antonyms FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY o) AS n FROM opp) WHERE n <= 4 GROUP BY ref)
SELECT q.qid, r.place, r.synset, y.definition, x.text AS example, p.name AS synonyms, coalesce(antonyms, '') AS antonyms, coalesce(related, '') AS related, r.synset IS NOT NULL AS found, coalesce(n - 5, 0) * CAST(coalesce(n, 0) > 5 AS INT) AS more_meanings
FROM q LEFT JOIN r ON r.qid = q.qid AND r.place <= 5 LEFT JOIN synsets y ON y.id = r.synset LEFT JOIN examples x ON x.synset_id = r.synset LEFT JOIN p ON 'y' || p.k = r.synset LEFT JOIN a4 ON a4.ref = r.synset || '.0' LEFT JOIN k4 ON k4.synset = r.synset"""
)
def word_screen(spark, sf_dir):
    t = sample.lexicon(spark, sf_dir)
    unfit, bad = sample.unfit(t)
    first = t["senses"].filter("member_rank = 1").select(F.substring("synset_id", 2, 20).cast("long").alias("k"), F.col("lemma").alias("word")).filter("k % 4 = 0")
    asked = first.groupBy("word").agg(F.min("k").alias("qid")).select("qid", "word").union(spark.range(1).select(F.lit(-1).cast("long"), F.lit("zz")))
    synonyms = t["senses"].select(F.col("synset_id").alias("synset"), F.col("lemma").alias("word"), F.col("lemma").alias("key"), F.lit(sample.SOURCE).alias("source"), F.lit(1.0).alias("score"))
    out = screen.screens(asked, t, synonyms, unfit, bad).select("qid", "found", F.col("more_meanings").cast("long").alias("more_meanings"), F.explode_outer("meanings").alias("m"))
    words = lambda c: F.array_join(F.transform(c, lambda x: x["word"]), ",")
    return out.select("qid", F.col("m.place").cast("long").alias("place"), "m.synset", "m.definition", "m.example", words("m.synonyms").alias("synonyms"), F.coalesce(F.array_join("m.antonyms", ","), F.lit("")).alias("antonyms"), F.coalesce(words("m.related"), F.lit("")).alias("related"), "found", "more_meanings")
