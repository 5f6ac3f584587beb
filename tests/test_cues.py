"""Names, the full cue set and the picker that uses them."""

from pyspark.sql import functions as F

from lexloom.operators import cues, picker
from lexloom.plans import serving

LISTS = serving.LISTS
SAID = ["Sofia trains Nina's dog", "Duck!", "We saw Canada", "pretty shells", "Wind the clock", "The school bell rings", "the old stone well", "OK Bob", ""]


def tables(spark):
    q = spark.createDataFrame([(i, s, "x", None) for i, s in enumerate(SAID)], "qid int, sentence string, target string, at int")
    lexicon = spark.createDataFrame([("duck", "duck", "noun.animal"), ("canada", "Canada", "noun.location"), ("sofia", "Sofia", "noun.person"), ("the", "the", None)], "key string, lemma string, lexfile string")
    lemmas = spark.createDataFrame(
        [("trains", "train", "v"), ("trains", "train", "n"), ("duck", "duck", "v"), ("duck", "duck", "n"), ("pretty", "pretty", "a"), ("shells", "shell", "n"), ("rings", "ring", "v"), ("rings", "ring", "n"), ("well", "well", "n"), ("stone", "stone", "n")],
        "word string, lemma string, pos string",
    )
    stop = spark.createDataFrame([(w,) for w in serving.STOP], "key string")
    words = picker.sentence_tokens(q)
    return q, words, lexicon, lemmas, stop


def test_names(spark):
    _, words, lexicon, _, _ = tables(spark)
    assert {(r.qid, r.j) for r in cues.names(words, lexicon).collect()} == {(0, 0), (0, 2), (2, 0), (4, 0), (7, 1)}


def test_full_cues(spark):
    q, words, lexicon, lemmas, stop = tables(spark)
    rows = cues.full_cues(q, words, lemmas, stop, cues.names(words, lexicon), LISTS).collect()
    got = {(r.qid, r.j, r.pos): r.strength for r in rows}
    assert got[0, 1, "v"] == 0.8  # behind a name
    assert got[0, 3, "n"] == 1.0  # behind a possessive
    assert got[1, 0, "v"] == 0.8  # a cry
    assert got[3, 1, "n"] == 1.0  # behind an adjective
    assert got[4, 0, "v"] == 1.3  # first, and before a determiner
    assert (5, 3, "n") not in got  # a verb form looks back one word only
    assert got[6, 3, "n"] == 0.8


def test_full_picker(spark):
    served, asked = serving.fixture(spark)
    words = picker.sentence_tokens(asked)
    none = spark.createDataFrame([], "qid int, j int")
    bonus = spark.createDataFrame([(3, "river-bank", 6.0)], "qid int, synset string, bonus double")
    lemmas = served["entry"].select(F.col("key").alias("word"), F.col("key").alias("lemma"), "pos")
    hints = cues.full_cues(asked, words, lemmas, served["stop"], none, LISTS)
    named = words.filter("word = 'boat'").select("qid", "j")
    top = {r.qid: (r.synset, list(r.clues)) for r in picker.pick(asked, served, LISTS, named, hints, bonus).collect() if r.place == 1}
    assert top[1] == ("river-bank", ["ducks"]) and top[3][0] == "river-bank" and top[4][0] == "bank-tilt" and 7 not in top
