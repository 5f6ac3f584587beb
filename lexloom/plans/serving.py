"""The small serving fixture as tables, and the serving build from integrated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.rules import EXP_KEEP, SIG_KEEP, SYN_KEEP
from lexloom.functions.text import inflections, lookup_key, sound_key
from lexloom.operators import features, graph, picker
from lexloom.operators import lexicon as lemmatiser
from lexloom.sources.scratch import cut

# fixed values: a tiny lexicon that the picker's expected scores refer to
STOP = "the where were towards i into my a we can to is was so very it".split()
LISTS = {"determiners": ["a", "an", "my", "the"], "subjects": ["i", "we", "they"], "modals": ["can", "to", "will"], "copulas": ["is", "was"], "degree": ["so", "very"], "prepositions": ["into", "on", "towards"], "generic": ["make", "thing"]}
TOK = [("ducks", "duck", 1), ("drifted", "drift", 1), ("banks", "bank", 1), ("paid", "pay", 1), ("saw", "saw", 1), ("saw", "see", 2)]
ENTRY = [("bank", "bank", "n", "money-bank", 1), ("bank", "bank", "n", "river-bank", 2), ("duck", "duck", "n", "duck-bird", 1), ("bright", "bright", "a", "bright-light", 1), ("bright", "bright", "a", "bright-clever", 2), ("knowledge", "knowledge", "n", "knowledge-n", 1), ("bank", "bank", "v", "bank-tilt", 1), ("pond", "pond", "n", "pond-n", 1), ("torch", "torch", "n", "torch-n", 1)]
MEANING = [(1, "money-bank", 40), (2, "river-bank", 40), (3, "duck-bird", 10), (4, "bright-light", 30), (5, "bright-clever", 30), (6, "knowledge-n", 10), (7, "bank-tilt", 40), (8, "pond-n", 10), (9, "torch-n", 10)]
KW = list(enumerate("money pay boat duck river light sun clever pupil water plane pond torch".split(), 1))
SIG = [(1, 1, 650), (1, 2, 400), (2, 3, 500), (2, 4, 450), (2, 5, 700), (2, 10, 300), (4, 6, 300), (4, 7, 500), (5, 8, 600), (5, 9, 550), (7, 11, 800)]
EXP = [(12, 10, 100), (12, 5, 60), (13, 6, 100)]
SENTENCES = [
    (1, "The little boat drifted slowly towards the bank, where the ducks were waiting.", "bank"),
    (2, "I paid the money into my bank.", "bank"),
    (3, "Look at the bank.", "bank"),
    (4, "We can bank the plane.", "bank"),
    (5, "The pond is by the bank.", "bank"),
    (6, "The torch was so bright.", "bright"),
    (7, "A zebra ran.", "zebra"),
]


def fixture(spark: SparkSession) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, queries) of the tiny lexicon."""
    def make(rows, schema):
        """Rows as literals of the plan, so that their size is known and joins broadcast them."""
        names, kinds = zip(*(f.split() for f in schema.split(", ")))
        columns = lambda r: F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(names, kinds, r)])
        return spark.range(1).select(F.inline(F.array(*map(columns, rows))))

    tables = {
        "stop": make([(w,) for w in STOP], "key string"),
        "tok": make(TOK, "form string, key string, ord int"),
        "entry": make(ENTRY, "key string, lemma string, pos string, synset string, rank int"),
        "meaning": make(MEANING, "mid int, id string, sigsize int"),
        "kw": make(KW, "kid int, key string"),
        "sig": make(SIG, "mid int, kid int, w int"),
        "exp": make(EXP, "kid int, ekid int, w int"),
    }
    return tables, make([(*s, None) for s in SENTENCES], "qid int, sentence string, target string, at int")


#: Least idf of a word that links meanings, and keys at least this heavy stay in a signature.
LINK_IDF, LEAST_WEIGHT = 4.5, 0.05


def number(c: Column) -> Column:
    """The number of a meaning or key in the tables: a hash, so that no order over all of them is needed."""
    return F.xxhash64(c)


def shown_entries(lexicon: dict[str, DataFrame], unfit: DataFrame, bad: DataFrame) -> DataFrame:
    """(key, lemma, pos, synset, rank): fit meanings of fit words of at most two words and no capital; the lowest rank counts."""
    senses = lexicon["senses"].join(lexicon["entries"].select(F.col("id").alias("entry_id"), "lemma_key"), "entry_id")
    fit = senses.join(unfit.select(F.col("id").alias("synset_id")), "synset_id", "left_anti").join(bad.select(F.col("key").alias("lemma_key")), "lemma_key", "left_anti")
    fit = fit.filter(~F.col("lemma").rlike(r"^\p{Lu}") & (F.size(F.split("lemma_key", " ")) <= 2))
    row = F.struct("rank", "lemma", graph.folded(F.col("pos")).alias("pos"))
    return fit.groupBy(F.col("lemma_key").alias("key"), F.col("synset_id").alias("synset")).agg(F.min(row).alias("e")).select("key", "e.lemma", "e.pos", "synset", "e.rank")


def shown_synonyms(synonyms: DataFrame, entry: DataFrame, bad: DataFrame, main: str, keep: int = SYN_KEEP) -> DataFrame:
    """(synset, ord, word, source): the lexicon's own words first, then by score and spelling; ``synonyms`` (synset, word, source, score)."""
    own = synonyms.join(entry.select("synset").distinct(), "synset", "left_semi").withColumn("key", lookup_key(F.col("word"))).join(bad.select("key"), "key", "left_anti")
    by = Window.partitionBy("synset").orderBy(F.col("source") != main, F.desc("score"), "word")
    return own.select("synset", F.row_number().over(by).alias("ord"), "word", "source").filter(F.col("ord") <= keep)


def shown_antonyms(lexicon: dict[str, DataFrame], entry: DataFrame, bad: DataFrame) -> DataFrame:
    """(synset, word): opposites of the senses of a meaning."""
    ends = lexicon["senses"].select("id", "synset_id", "lemma")
    a = ends.select(F.col("id").alias("src_sense"), F.col("synset_id").alias("synset"))
    b = ends.select(F.col("id").alias("dst_sense"), F.col("lemma").alias("word"))
    pairs = lexicon["sense_relations"].filter("rel = 'antonym'").join(a, "src_sense").join(b, "dst_sense").select("synset", "word").distinct()
    pairs = pairs.join(entry.select("synset").distinct(), "synset", "left_semi").withColumn("key", lookup_key(F.col("word")))
    return pairs.join(bad.select("key"), "key", "left_anti").select("synset", "word")


def signatures(weights: DataFrame, idf: DataFrame, keep: int = SIG_KEEP) -> DataFrame:
    """(synset, key, w, size): the strongest words of a meaning by weight x idf, in hundredths, and all its words counted."""
    own = weights.join(idf.select("key", "idf"), "key").withColumn("v", F.round(F.col("w") * F.col("idf"), 6))
    by = Window.partitionBy("synset")
    ranked = own.withColumn("size", F.count(F.lit(1)).over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("v"), F.desc("key"))))
    return ranked.filter((F.col("place") <= keep) & (F.col("v") >= LEAST_WEIGHT)).select("synset", "key", F.round(F.col("v") * 100).cast("int").alias("w"), "size")


def clue_links(entry: DataFrame, bags: DataFrame, idf: DataFrame, stop: DataFrame, generic: DataFrame, keep: int = EXP_KEEP) -> DataFrame:
    """(key, link, w, place): what the meanings of each word of one part are about."""
    skip = stop.select("key").union(generic.select("key")).distinct()
    words = entry.filter(~F.col("key").contains(" ")).join(skip, "key", "left_anti").select("key", "synset", "rank")
    found = features.expand(words, bags, idf.select(F.col("key").alias("link"), "idf"), skip.withColumnRenamed("key", "link"), LINK_IDF)
    return features.links_of(found.withColumn("mean", F.round("mean", 9)), keep)


def form_rows(entry: DataFrame, lexicon: dict[str, DataFrame]) -> DataFrame:
    """(form, key, ord): spellings and the words they stand for; a word that stands only for itself needs no row."""
    words = entry.select("key", "pos").distinct()
    forms = words.select(F.col("key").alias("form")).union(words.select(F.explode(inflections(F.col("key"), F.col("pos"))))).union(lexicon["forms"].select("form_key")).distinct()
    keys = lemmatiser.word_keys(forms.select(F.col("form").alias("word")), lexicon["entries"], lexicon["forms"]).select(F.col("word").alias("form"), "place", "key")
    keys = keys.join(words.select("key").distinct(), "key", "left_semi")
    alone = F.count(F.lit(1)).over(Window.partitionBy("form")) == 1
    rows = keys.withColumn("alone", alone).filter(~(F.col("alone") & (F.col("key") == F.col("form"))))
    return rows.select("form", "key", F.row_number().over(Window.partitionBy("form").orderBy("place")).alias("ord"))


def pronunciations(entry: DataFrame, lexicon: dict[str, DataFrame], first: str = "GB") -> DataFrame:
    """(key, ipa): one per word, of the ``first`` variety if there is one, unnamed varieties last."""
    own = lexicon["pronunciations"].join(lexicon["entries"].select(F.col("id").alias("entry_id"), F.col("lemma_key").alias("key")), "entry_id")
    own = own.join(entry.select("key").distinct(), "key", "left_semi")
    order = F.struct(F.coalesce(F.col("variety") != first, F.lit(True)), F.col("variety").isNull(), "variety", "entry_id", "ipa")
    return own.groupBy("key").agg(F.min_by("ipa", order).alias("ipa"))


def glosses(lexicon: dict[str, DataFrame], stop: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lemma keys (synset, key) of the definitions, of the examples beyond them, and (synset, key, lemma) of the members."""
    definitions = lexicon["synsets"].select("id", F.col("definition").alias("text"))
    by_seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    examples = lexicon["examples"].groupBy(F.col("synset_id").alias("id")).agg(by_seq.alias("text"))
    words = cut(lemmatiser.text_words(definitions, examples), "words")
    keys = cut(lemmatiser.word_keys(words, lexicon["entries"], lexicon["forms"]), "word-keys")
    said = cut(lemmatiser.content_lemma_keys(definitions, keys, stop).select(F.col("id").alias("synset"), "key"), "definition-keys")
    shown = lemmatiser.content_lemma_keys(examples, keys, stop).select(F.col("id").alias("synset"), "key").join(said, ["synset", "key"], "left_anti")
    members = lexicon["senses"].select(F.col("synset_id").alias("synset"), lookup_key(F.col("lemma")).alias("key"), "lemma").distinct()
    return said, cut(shown, "example-keys"), cut(members, "members")


def frequencies(definitions: DataFrame, examples: DataFrame, members: DataFrame, synsets: DataFrame, stop: DataFrame) -> DataFrame:
    """(key, df, idf) over meanings as documents: the words of definition, examples and members, and parts of members."""
    parts = members.select("synset", F.explode(F.split("key", "[ -]+")).alias("key")).filter("key != ''").join(stop.select("key"), "key", "left_anti").select("synset", "key")
    rows = definitions.select("synset", "key").union(examples.select("synset", "key")).union(members.select("synset", "key")).union(parts)
    found = features.gloss_frequencies(rows, synsets.agg(F.count(F.lit(1)).alias("n")))
    return cut(found.withColumn("key", F.replace("key", F.lit(" "), F.lit("_"))), "idf")


def meta_table(spark: SparkSession, lists: dict[str, list[str]]) -> DataFrame:
    """(key, value): the picker's numbers and word lists, as text."""
    notes = {k: str(v) for k, v in picker.NUMBERS.items()} | {f"words_{n}": " ".join(sorted(w)) for n, w in lists.items()} | {"schema_version": "1"}
    return spark.createDataFrame(sorted(notes.items()), "key string, value string")


def build(lexicon: dict[str, DataFrame], unfit: DataFrame, bad: DataFrame, synonyms: DataFrame | None = None, stop: DataFrame | None = None, lists: dict[str, list[str]] | None = None, main: str = "base") -> dict[str, DataFrame]:
    """All tables of the serving layer: stop, tok, entry, meaning, syn, ant, kw, sig, exp, ipa, sound, meta.

    ``unfit`` (id) meanings and ``bad`` (key) words are left out; ``synonyms`` (synset, word, source, score) are the
    integrated ones, by default the lexicon's members; ``lists`` are the word lists of the picker.
    """
    spark = lexicon["senses"].sparkSession
    lists = lists or {}
    stop = stop if stop is not None else spark.createDataFrame([], "key string")
    entry = cut(shown_entries(lexicon, unfit, bad), "entry")
    fit = entry.select(F.col("synset").alias("id")).distinct()
    definitions, examples, members = glosses(lexicon, stop)
    if synonyms is None:
        synonyms = lexicon["senses"].select(F.col("synset_id").alias("synset"), F.col("lemma").alias("word"), F.lit(main).alias("source"), F.lit(1.0).alias("score"))
    book = synonyms.filter(F.col("source") != main).select("synset", lookup_key(F.col("word")).alias("key")).distinct()
    links = graph.weighted(lexicon["synset_relations"], lexicon["sense_relations"], lexicon["senses"])
    idf = frequencies(definitions, examples, members, lexicon["synsets"], stop)
    weights = features.relation_signature(members.select("synset", "key"), definitions, examples, links, book, stop)
    sig = cut(signatures(weights.join(fit.withColumnRenamed("id", "synset"), "synset", "left_semi"), idf), "sig")
    generic = spark.createDataFrame([(w,) for w in lists.get("generic", [])], "key string")
    exp = cut(clue_links(entry, features.bags(members, definitions, lexicon["synset_relations"]), idf, stop, generic), "exp")
    first = lexicon["examples"].filter("seq = 1").select(F.col("synset_id").alias("id"), F.col("text").alias("example"))
    size = sig.groupBy(F.col("synset").alias("id")).agg(F.max("size").cast("int").alias("sigsize"))
    meaning = lexicon["synsets"].join(fit, "id", "left_semi").join(first, "id", "left").join(size, "id", "left")
    meaning = cut(meaning.select(number(F.col("id")).alias("mid"), "id", graph.folded(F.col("pos")).alias("pos"), "definition", "example", F.coalesce("sigsize", F.lit(0)).alias("sigsize")), "meaning")
    keys = sig.select("key").union(exp.select("key")).union(exp.select("link")).distinct()
    return {
        "stop": stop.select("key").distinct(),
        "tok": cut(form_rows(entry, lexicon), "tok"),
        "entry": entry,
        "meaning": meaning,
        "syn": shown_synonyms(synonyms, entry, bad, main),
        "ant": shown_antonyms(lexicon, entry, bad),
        "kw": keys.select(number(F.col("key")).alias("kid"), "key"),
        "sig": sig.select(number(F.col("synset")).alias("mid"), number(F.col("key")).alias("kid"), "w"),
        "exp": exp.select(number(F.col("key")).alias("kid"), number(F.col("link")).alias("ekid"), "w"),
        "ipa": pronunciations(entry, lexicon),
        "sound": entry.select(sound_key(F.col("key")).alias("skey"), "key").filter("skey != '' and key not like '% %'").distinct(),
        "meta": meta_table(spark, lists),
    }
