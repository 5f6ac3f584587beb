"""Text functions, picker, search, sources against expected values."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as fn
from lexloom.operators import align, collocation, evaluate, features, graph, lexicon, picker, screen, search
from lexloom.plans import serving
from lexloom.sources import books, lmf
from lexloom.streaming.lookup import lookup_stream

SOUNDS = {
    "nolij": "nlj", "knowledge": "nlj", "fotograf": "ftgrf", "photograph": "ftgrf", "enormus": "anrms", "enormous": "anrms",
    "nife": "nf", "knife": "nf", "sircle": "srkl", "circle": "srkl", "wrong": "rng", "rong": "rng", "edge": "aj", "ej": "aj",
    "school": "skl", "skool": "skl", "lamb": "lm", "lam": "lm", "thumb": "Tm", "fum": "fm", "jiraf": "jrf", "giraffe": "jrf",
    "kwiet": "kt", "quiet": "kt", "box": "bks", "boks": "bks", "Science": "sns", "sients": "snts", "where": "wr", "wear": "wr",
    "": "", "123": "", "Élan": "ln",
}


def test_sound_key(spark):
    df = spark.createDataFrame([(k,) for k in SOUNDS], "w string")
    assert {r.w: r.s for r in df.select("w", fn.sound_key(F.col("w")).alias("s")).collect()} == SOUNDS


def test_keys_and_tokens(spark):
    df = spark.createDataFrame([("  Grandma’s_Hat \n straße",), (None,), ("",)], "t string")
    rows = df.select(fn.lookup_key(F.col("t")).alias("k"), fn.tokens(F.col("t")).alias("w")).collect()
    assert rows[0].k == "grandma's hat strasse"
    assert rows[0].w == ["Grandma’s", "Hat", "straße"]
    assert rows[1].w == [] and rows[2].w == []


def test_inflections_and_variants(spark):
    df = spark.createDataFrame([("carry", "v"), ("hat", "n"), ("ice cream", "n")], "l string, p string")
    forms = {r.l: set(r.f) for r in df.select("l", fn.inflections(F.col("l"), F.col("p")).alias("f")).collect()}
    assert {"carries", "carried", "carrying"} <= forms["carry"] and {"hats"} <= forms["hat"] and not forms["ice cream"]
    df = spark.createDataFrame([("color",), ("center",), ("gray",), ("catalog",), ("hat",)], "w string")
    got = [r.v for r in df.select(fn.british_variants(F.col("w")).alias("v")).collect()]
    assert got == [["colour"], ["centre"], ["grey"], ["catalogue"], []]


def test_blocked(spark):
    df = spark.createDataFrame([("dirt",), ("dirt road",), ("mud",), ("mud pie",), ("grimeball",), ("grime tree",)], "k string")
    got = [r.b for r in df.select(fn.blocked(F.col("k"), ["dirt", "mud"], ["mud"], ["grime"], ["grime tree"]).alias("b")).collect()]
    assert got == [True, True, True, False, True, False]


def test_picker_scores(spark):
    tables, asked = serving.fixture(spark)
    rows = picker.pick(asked, tables, serving.LISTS).collect()
    top = {r.qid: (r.synset, r.score, list(r.clues)) for r in rows if r.place == 1}
    assert top == {
        1: ("river-bank", 13.477, ["boat", "ducks"]),
        2: ("money-bank", 15.467, ["money", "paid"]),
        3: ("money-bank", 6.0, []),
        4: ("bank-tilt", 13.692, ["plane"]),
        5: ("river-bank", 6.786, ["pond"]),
        6: ("bright-light", 6.972, ["torch"]),
    }
    assert [r.synset for r in sorted(rows, key=lambda r: r.place) if r.qid == 1] == ["river-bank", "money-bank", "bank-tilt"]
    links = {(x.clue, x.matched, x.channel) for r in rows if r.place == 1 for x in r.links}
    assert ("boat", "boat", "direct") in links and ("pond", "river", "indirect") in links or ("pond", "water", "indirect") in links
    plain = picker.pick(asked, tables, serving.LISTS, numbers={"indirect": 0.0}).filter("place = 1").collect()
    assert {x.channel for r in plain for x in r.links} == {"direct"} and next(r.score for r in plain if r.qid == 3) == 6.0
    gold = spark.createDataFrame([(1, "river-bank"), (3, "river-bank"), (7, "none")], "qid int, synset string")
    wrong = evaluate.failures(spark.createDataFrame([(r.qid, r.place, r.synset) for r in rows], "qid int, place int, synset string"), gold).collect()
    assert sorted((r.qid, r.said, list(r.right)) for r in wrong) == [(3, "money-bank", ["river-bank"]), (7, None, ["none"])]


def test_vocabulary_and_stores(spark, tmp_path):
    from lexloom.operators import vocabulary
    from lexloom.sources import stores

    df = spark.createDataFrame([("(hat)!",), ("--",), ("it's",), ("",), (None,)], "w string")
    assert [r.s for r in df.select(fn.edge_strip(F.col("w")).alias("s")).collect()] == ["hat", "", "it's", "", None]
    shapes = spark.createDataFrame([("ice-cream",), ("a.m.",), ("3d",), ("x1",), ("two words",), ("",)], "w string")
    assert [r.s for r in shapes.select(fn.word_shape(F.col("w")).alias("s")).collect()] == [True, True, False, False, True, False]
    text = 'He said "No." then left. A boat, e.g. a big one! Is it?\n\nNew part'
    where = spark.createDataFrame([(text, 3), (text, 30), (text, 52), (text, 999), ("", 4), (None, 1)], "t string, at int")
    got = [r.s for r in where.select(fn.sentence_around(F.col("t"), F.col("at")).alias("s")).collect()]
    assert got == ['He said "No." then left.', "A boat, e.g. a big one!", "Is it?", "New part", "", ""]
    with pytest.raises(Exception, match="unknown part of speech"):
        spark.createDataFrame([("zzz",)], "p string").select(fn.normalise_pos(F.col("p"))).collect()
    senses = spark.createDataFrame([("c1", "e1", "color", "s1", 1), ("c2", "e2", "colour", "s1", 2), ("a", "e3", "American spelling", "s9", 1), ("b", "e4", "British spelling", "s9", 1), ("g", "e5", "gray", "s2", 1), ("f", "e6", "fiber", "s3", 1), ("h", "e7", "fibred", "s3", 2)], "id string, entry_id string, lemma string, synset_id string, member_rank int")
    entries = senses.select(F.col("entry_id").alias("id"), "lemma", fn.lookup_key(F.col("lemma")).alias("lemma_key"), F.lit("n").alias("pos"))
    edges = spark.createDataFrame([("c1", "exemplifies", "a"), ("f", "exemplifies", "a"), ("h", "exemplifies", "b"), ("g", "exemplifies", "a"), ("g", "exemplifies", "b")], "src_sense string, rel string, dst_sense string")
    words = entries.select(F.col("lemma_key").alias("key"))
    assert {r.key for r in vocabulary.american_only(words, senses, entries, edges).collect()} == {"color", "fiber"}
    asked = spark.createDataFrame([("s1", "color"), ("s2", "gray"), ("s3", "fiber")], "synset string, word string")
    assert {r.word: r.form for r in vocabulary.british_forms(asked, senses, entries, edges).collect()} == {"color": "colour", "gray": "gray", "fiber": "fibred"}
    home = str(tmp_path / "catalog")
    with pytest.raises(FileNotFoundError, match="build the catalog first"):
        stores.open_table(spark, home, "t")
    stores.build(spark, home, {"t": spark.range(3)})
    with pytest.raises(Exception, match="forbidden"):
        stores.build(spark, home, {"t": stores.guard(spark.createDataFrame([("a Forbidden word",)], "x string"), "forbidden")})
    assert stores.open_table(spark, home, "t").count() == 3 and sorted(p.name for p in tmp_path.iterdir()) == ["catalog"]
    meta = stores.metadata({"t": spark.range(3)}, {"prior": "2.5"})
    assert stores.parameters(meta, ["prior"]) == {"prior": 2.5} and stores.report(meta) == '{"prior": "2.5", "rows_t": "3"}'


def test_heads_alignment(spark):
    """A thesaurus group against a tiny lexicon: the best meaning, kept and withheld words, reasons."""
    from lexloom.plans import assembly

    meanings = {"m1": ("n", ["bank", "shore"]), "m2": ("n", ["bank", "vault"]), "m3": ("n", ["shore", "coast"]), "m4": ("n", ["slope"]), "m5": ("n", ["lake"]), "m6": ("n", ["pond"]), "m7": ("n", ["pool"])}
    rows = [(f"{m}.{i}", f"e-{w}", w, p, m, 1, i + 1) for m, (p, ws) in meanings.items() for i, w in enumerate(ws)]
    senses = spark.createDataFrame(rows, "id string, entry_id string, lemma string, pos string, synset_id string, rank int, member_rank int")
    t = {
        "senses": senses,
        "entries": senses.select(F.col("entry_id").alias("id"), "lemma", F.col("lemma").alias("lemma_key"), "pos").distinct(),
        "synsets": spark.createDataFrame([(m, p, "") for m, (p, _) in meanings.items()], "id string, pos string, definition string"),
        "forms": spark.createDataFrame([], "entry_id string, form string, form_key string"),
        "synset_relations": spark.createDataFrame([("m1", "hypernym", "m4"), ("m4", "hyponym", "m1"), ("m1", "similar", "m3"), ("m3", "similar", "m1")], "src string, rel string, dst string"),
        "sense_relations": spark.createDataFrame([], "src_sense string, rel string, dst_sense string"),
    }
    stop = spark.createDataFrame([("the",)], "key string")
    none = spark.createDataFrame([], "synset string, key string")
    b = assembly.base(t, stop, none, spark.createDataFrame([], "key string"))
    group = "array<struct<pos string, para int, label string, words array<string>, unrecognised array<string>, labels map<string,array<string>>>>"
    heads = spark.createDataFrame([("7", "Edges", [("n", 0, None, ["bank", "shore", "slope", "lake", "zzzz"], [], {}), ("int", 0, None, ["bank", "ah"], [], {}), ("n", 1, None, ["vault", "rude"], [], {"rude": ["slang"]})])], f"head string, name string, groups {group}")
    got = assembly.align_heads(b, heads, "old")
    aligned = {(r.ref, r.headword): r.synset for r in got["alignments"].collect()}
    assert aligned["7:0", "bank"] == "m1" and {k[0] for k in aligned} == {"7:0"}
    synonyms = {(r.synset, r.word) for r in got["synonyms"].collect()}
    assert {("m1", "shore"), ("m1", "slope")} <= synonyms and ("m1", "lake") not in synonyms
    assert ("m1", "lake", "far") in {(r.synset, r.word, r.relation) for r in got["withheld"].collect()}
    reasons = {(r.ref, r.headword): r.reason for r in got["unaligned"].collect()}
    assert reasons["7:0", "zzzz"] == "no_entry" and reasons["7:0", "lake"] == "below_threshold" and reasons["7:1", "ah"] == "unsupported_pos"


def test_lemmatise(spark):
    lemmas = spark.createDataFrame([("run", "v"), ("city", "n"), ("bus", "n"), ("big", "a"), ("wolf", "n")], "lemma string, pos string")
    odd = spark.createDataFrame([("ran", "run", "v")], "form string, lemma string, pos string")
    words = spark.createDataFrame([(w,) for w in ("running", "cities", "buses", "bigger", "wolves", "ran", "run", "zzz")], "word string")
    assert {(r.word, r.lemma) for r in lexicon.lemmatise(words, lemmas, odd).collect()} == {("running", "run"), ("cities", "city"), ("buses", "bus"), ("bigger", "big"), ("wolves", "wolf"), ("ran", "run"), ("run", "run")}


def test_search(spark):
    v = spark.createDataFrame([(w,) for w in ("bright", "brighter", "brick", "knowledge", "bank")], "key string")
    q = spark.createDataFrame([("bri",), ("nolij",), ("",), ("b",)], "query string")
    assert [r.key for r in search.completions(q, v).orderBy("place").collect() if r.query == "bri"] == ["brick", "bright", "brighter"]
    assert [r.key for r in search.completions(q, v).orderBy("place").collect() if r.query == "b"] == ["bank", "brick", "bright", "brighter"]
    assert [r.key for r in search.suggestions(q, v).collect() if r.query == "nolij"] == ["knowledge"]


def test_align_and_merge(spark):
    s = spark.createDataFrame([("g1", "a", 3.0, 1.0, 1), ("g1", "b", 1.0, 1.0, 2), ("g2", "a", 2.0, 1.0, 2), ("g2", "b", 1.9, 1.0, 1), ("g3", "a", 0.5, 0.5, 1)], "group string, target string, score double, part double, ord int")
    assert {r.group: (r.target, r.verdict) for r in align.decide(s).collect()} == {"g1": ("a", "aligned"), "g2": ("a", "tie"), "g3": ("a", "below_threshold")}
    m = spark.createDataFrame([("k", 0.5, "one", 1), ("k", 0.5, "two", 2), ("k", 0.4, "three", 0)], "key string, w double, how string, ord int")
    assert features.max_merge(m, ["key"]).first().how == "one"


def test_graph(spark):
    e = spark.createDataFrame([("a", "hypernym", "p"), ("b", "hypernym", "p"), ("p", "hyponym", "a"), ("s", "similar", "h"), ("h", "similar", "s"), ("h", "similar", "t")], "src string, rel string, dst string")
    got = {(r.src, r.dst): r.label for r in graph.near(e).collect()}
    assert got[("a", "b")] == "sibling" and got[("a", "p")] == "hypernym" and got[("s", "t")] == "similar" and ("s", "s") not in got
    direct = spark.createDataFrame([("h", "x")], "id string, antonym string")
    similar = spark.createDataFrame([("s", "h"), ("h", "h")], "id string, head string")
    assert {(r.id, r.antonym, r.indirect) for r in graph.antonyms(direct, similar).collect()} == {("h", "x", False), ("s", "x", True)}


def test_screen_and_evaluate(spark):
    rows = spark.createDataFrame([("s", "shore", "Shore", "book1", 1.0), ("s", "shore", "shore", "base", 1.0), ("s", "river side", "river side", "book2", 3.0)], "synset string, key string, word string, source string, score double")
    fam = spark.createDataFrame([("shore", 2)], "key string, senses int")
    got = screen.rank_synonyms(rows, fam, 5).orderBy("place").collect()
    assert [(r.word, r.sources) for r in got] == [("shore", ["base", "book1"]), ("river side", ["book2"])]
    w = spark.createDataFrame([(50.0, 80.0), (0.0, 0.0)], "k double, n double").select(fn.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert (round(w[0].w.low, 3), round(w[0].w.high, 3)) == (0.515, 0.723) and w[1].w.low == 0.0
    v = spark.createDataFrame([("a", float(x)) for x in range(1, 12)], "g string, x double")
    import statistics

    assert evaluate.exclusive_quantile(v, ["g"], "x", 9).first().value == statistics.quantiles(range(1, 12), n=10)[-1]
    with pytest.raises(ValueError):
        screen.require(None, "unfit")


def test_books(spark, tmp_path):
    (tmp_path / "book.txt").write_bytes("﻿head\r\n*** START x\r\nOne.\r\n\r\nTwo-\r\nfold.\r\n*** END x\r\n".encode())
    text = books.book_text(spark, str(tmp_path / "book.txt"), r"\*\*\* START", r"\*\*\* END").first().text
    assert text == "One.\n\nTwo-\nfold.\n"
    (tmp_path / "bad.txt").write_text("no markers")
    with pytest.raises(Exception, match="markers missing"):
        books.book_text(spark, str(tmp_path / "bad.txt"), "START", "END").collect()
    rows = books.lines(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t")
    assert [r.text for r in books.paragraphs(rows).orderBy("line").collect()] == ["One.", "Two-fold."]
    s = spark.createDataFrame([('He said "No." Then left. e.g. this one!\n\nNew',)], "t string").select(books.sentences(F.col("t")).alias("s")).first().s
    assert s == ['He said "No."', "Then left. e.g. this one!", "New"]


LMF = """<?xml version="1.0" encoding="UTF-8"?>
<LexicalResource xmlns:dc="https://example.org/dc/"><Lexicon id="x" label="x" language="en">
<LexicalEntry id="e-cat"><Lemma writtenForm="Cat" partOfSpeech="n"><Pronunciation variety="GB">k&#230;t</Pronunciation><Pronunciation variety="US"> </Pronunciation></Lemma><Form writtenForm="cats"/>
<Sense id="cat-1" synset="s1"><SenseRelation relType="antonym" target="dog-1"/></Sense><Sense id="cat-2" synset="s2"/></LexicalEntry>
<LexicalEntry id="e-dog"><Lemma writtenForm="dog" partOfSpeech="n"/><Sense id="dog-1" synset="s2"><SenseRelation relType="antonym" target="cat-1"/><SenseRelation relType="antonym" target="cat-1"/></Sense></LexicalEntry>
<Synset id="s1" ili="in" partOfSpeech="n" lexfile="noun.animal" members="e-cat"><Definition>a small
 animal</Definition><Definition>a pet</Definition><Example> </Example><Example>the cat sat</Example><SynsetRelation relType="hypernym" target="s2"/></Synset>
<Synset id="s2" ili="i2" partOfSpeech="n" dc:subject="noun.top" members="e-dog e-cat"><Definition>an animal</Definition><SynsetRelation relType="hyponym" target="s1"/></Synset>
</Lexicon></LexicalResource>"""


def test_lexicon_source(spark, tmp_path):
    (tmp_path / "x.xml").write_text(LMF, encoding="utf-8")
    t = lmf.read(spark, str(tmp_path / "x.xml"), "test")
    syn = {r.id: r for r in t["synsets"].collect()}
    assert syn["s1"].definition == "a small animal; a pet" and syn["s1"].ili is None and syn["s2"].ili == "i2" and syn["s2"].lexfile == "noun.top"
    assert {(r.id, r["rank"], r.member_rank) for r in t["senses"].collect()} == {("cat-1", 1, 1), ("cat-2", 2, 2), ("dog-1", 1, 1)}
    assert [(r.seq, r.text) for r in t["examples"].collect()] == [(1, "the cat sat")]
    assert [r.ipa for r in t["pronunciations"].collect()] == ["kæt"] and t["sense_relations"].count() == 2
    assert all(r.n == 0 for r in lmf.integrity(t).collect())
    built = serving.build(t, spark.createDataFrame([("s9",)], "id string"), spark.createDataFrame([("zzz",)], "key string"))
    assert [r.key for r in built["entry"].collect()] == ["dog"]


def test_lookup_stream(spark, tmp_path):
    spark.createDataFrame([("Ducks",), ("pond",)], "word string").write.parquet(str(tmp_path / "in"))
    forms = spark.createDataFrame([("ducks", "duck")], "form string, key string")
    stream = spark.readStream.schema("word string").parquet(str(tmp_path / "in"))
    q = lookup_stream(stream, forms).writeStream.format("memory").queryName("looked").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.word, r.key) for r in spark.sql("select * from looked").collect()} == {("Ducks", "duck"), ("pond", "pond")}


def test_collocation(spark):
    said = "please sit on the river bank now".split()
    s = spark.createDataFrame([(1, j, w, w in ("on", "the")) for j, w in enumerate(said)], "qid int, j int, key string, is_stop boolean")
    t = spark.createDataFrame([(1, 5, "rb"), (1, 5, "mb")], "qid int, ti int, synset string")
    e = spark.createDataFrame([("rb", 1, i, w) for i, w in enumerate("we sat on the river bank".split())] + [("mb", 1, i, w) for i, w in enumerate("the bank".split())], "synset string, ex int, i int, key string")
    assert [(r.synset, r.run, r.bonus) for r in collocation.collocations(s, t, e).collect()] == [("rb", 4, 6.0)]


def test_expand(spark):
    senses = spark.createDataFrame([("pond", "s1", 1), ("pond", "s2", 2)], "key string, synset string, rank int")
    bags = spark.createDataFrame([("s1", "water", 1.0), ("s2", "fish", 0.6), ("s1", "pond", 1.0), ("s1", "thing", 1.0)], "synset string, link string, w double")
    idf = spark.createDataFrame([("water", 6.0), ("fish", 6.0), ("pond", 7.0), ("thing", 9.0)], "link string, idf double")
    skip = spark.createDataFrame([("thing",)], "link string")
    got = {r.link: (round(r["mean"], 4), r.best) for r in features.expand(senses, bags, idf, skip).collect()}
    total = 1 + 1 / 1.15
    assert got == {"water": (round(1 / total, 4), 1.0), "fish": (round(0.6 / 1.15 / total, 4), 0.6)}
    assert [(r.link, r.w) for r in features.links_of(features.expand(senses, bags, idf, skip)).orderBy("place").collect()] == [("water", 53), ("fish", 28)]


def test_alignment(spark):
    members = spark.createDataFrame([("a", "bank"), ("a", "river side"), ("b", "shore")], "synset string, key string")
    definitions = spark.createDataFrame([("a", "land")], "synset string, key string")
    edges = spark.createDataFrame([("a", "hypernym", "b")], "src string, rel string, dst string")
    stop = spark.createDataFrame([("side",)], "key string")
    hood = align.neighbourhood(members, definitions, edges, stop)
    assert {(r.synset, r.key): r.w for r in hood.collect()} == {("a", "bank"): 1.0, ("a", "river side"): 1.0, ("a", "river"): 0.5, ("a", "shore"): 0.6, ("a", "land"): 0.5, ("b", "shore"): 1.0}
    groups = spark.createDataFrame([("g", "group", "bank"), ("g", "group", "river land"), ("g", "context", "shore"), ("g", "name", "land")], "group string, role string, key string")
    candidates = spark.createDataFrame([("g", "a", 1), ("g", "b", 2)], "group string, target string, ord int")
    got = {r.target: (r.score, r.part) for r in align.group_scores(groups, candidates, hood).collect()}
    assert got == {"a": (1.525, 1.25), "b": (0.25, 0.0)}
    rows = [("g", f"w{i}", r, "n", None) for i, r in enumerate(["member", "hyponym", "far", "sibling", "unknown"])] + [("h", "x", "unknown", "n", None), ("h", "y", "hyponym", "v", None), ("k", "z", "unknown", "n", "List of birds")]
    kept = {(r.group, r.word): r.kept for r in align.keeps(spark.createDataFrame(rows, "group string, word string, relation string, pos string, label string")).collect()}
    assert [kept[("g", f"w{i}")] for i in range(5)] == [True, False, False, False, False] and kept[("h", "x")] and kept[("h", "y")] and not kept[("k", "z")]


def test_results_and_evaluation(spark):
    v = spark.createDataFrame([(w,) for w in ("bright", "brighter", "knowledge", "bank")], "key string")
    got = {}
    for r in search.results(spark.createDataFrame([("bright",), ("nolij",)], "query string"), v).orderBy("place").collect():
        got.setdefault(r.query, []).append((r.key, r.kind))
    assert got == {"bright": [("bright", "exact"), ("brighter", "completion")], "nolij": [("knowledge", "suggestion")]}
    p = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "qid int, place int, synset string")
    gold = spark.createDataFrame([(1, "b"), (1, "z"), (2, "c"), (3, "q")], "qid int, synset string")
    assert {r.qid: (r.gold_place, r.top1, r.top3) for r in evaluate.gold_rank(p, gold).collect()} == {1: (2, False, True), 2: (1, True, True), 3: (None, False, False)}
    entry = spark.createDataFrame([("bank", "n", "m", 1), ("bank", "v", "t", 1), ("bank", "n", "r", 2)], "key string, pos string, synset string, rank int")
    items = spark.createDataFrame([(1, "bank", "v")], "qid int, key string, pos string")
    assert evaluate.first_sense(items, entry).first().synset == "t" and evaluate.first_sense(items, entry, False).first().synset == "m"


def test_word_screens(spark):
    picked = spark.createDataFrame([(1, 2, "m", 2.0, ["x"]), (1, 1, "r", 5.0, ["boat"])], "qid int, place int, synset string, score double, clues array<string>")
    meanings = spark.createDataFrame([("m", "n", "money", None), ("r", "n", "river", "by the bank")], "synset string, pos string, definition string, example string")
    syn = spark.createDataFrame([("r", "shore", "shore", 1), ("r", "side of a river", "side of a river", 2)], "synset string, word string, key string, place int")
    ant = spark.createDataFrame([("r", "sea")], "synset string, word string")
    row = screen.word_screens(picked, meanings, syn, ant).first()
    assert [m.synset for m in row.meanings] == ["r", "m"] and row.meanings[0].synonyms == ["shore"] and row.meanings[0].antonyms == ["sea"] and row.margin == 3.0 and row.more_meanings == 0
    with pytest.raises(ValueError):
        screen.word_screens(picked, meanings, syn, ant, "expert")


def test_top_products(spark):
    from collections import Counter

    left = [(i, f"k{(i * j) % 11}", j) for i in range(9) for j in range(1, 8)]
    right = [(i, f"k{(i + j * j) % 17}", 1 + i % 3) for i in range(70) for j in range(4)] + [(None, "k1", 9)]
    distinct = lambda rows: list({(i, k): (i, k, w) for i, k, w in rows}.values())
    left, right = distinct(left), distinct(right + [(i, "all", 1) for i in range(70)])
    left += [(20, "all", 2), (21, "none", 2)]
    dot = Counter()
    for i, k, w in left:
        for j, q, v in right:
            if k == q:
                dot[i, j] += w * v
    want = []
    for i in {i for i, _ in dot}:
        best = sorted(((j, d) for (l, j), d in dot.items() if l == i), key=lambda x: (-x[1], x[0] is not None, x[0] or 0))
        want += [(i, j, d, n) for n, (j, d) in enumerate(best[:3], 1)]
    a, b = (spark.createDataFrame(x, "id long, key string, w long") for x in (left, right))
    for block in (20, 1000):
        assert sorted(map(tuple, features.top_products(a, b, 3, block).collect()), key=str) == sorted(want, key=str)


def test_sparse_dot_counts_common_keys(spark, tmp_path):
    from lexloom import queries

    spark.createDataFrame([(i, "water" if i < 40 else "water water") for i in range(41)] + [(50, "single")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "water"), (2, "single"), (3, "the")], "conv_id long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, queries.sparse_dot(spark, str(tmp_path)).collect()))
    assert got == [(1, 0, 1, 2), (1, 1, 1, 3), (1, 40, 2, 1), (2, 50, 1, 1)]
