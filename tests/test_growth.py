"""What a query holds or makes must grow no faster than its tables: checked on plans and counted rows."""

import re

import pytest
from pyspark.sql import functions as F

from lexloom import lexicon_queries, queries  # noqa: F401 (registers its queries)
from lexloom.operators import graph


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def most_rows(spark, df):
    """(rows, the largest number of rows that a step of the query put out)."""
    rows = df.collect()
    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsList()
    at = done.apply(done.size() - 1).executionId()
    values, nodes, most = store.executionMetrics(at), store.planGraph(at).allNodes(), 0
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for j in range(metrics.size()):
            value = values.get(metrics.apply(j).accumulatorId())
            if metrics.apply(j).name() == "number of output rows" and value.isDefined():
                most = max(most, int(re.sub(r"\D", "", value.get().split("\n")[0]) or 0))
    return rows, most


@pytest.mark.parametrize("name", ["sense_antonyms", "word_screen", "serving_ant", "weighted_relations", "synsets_of_words", "lemma_keys"])
def test_lexicon_is_not_broadcast(spark, name):
    """Only tables without a file behind them (stop lists) may be broadcast on a guess of their size.

    A check whether there is any row (limit 1) is no such table.
    """
    lines = plan(queries.QUERIES[name](spark, "/root/testdata/sf0.1")).split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange HashedRelation" in line:
            below = lines[i + 1 :]
            end = next((j for j, x in enumerate(below) if depth(x) <= depth(line)), len(below))
            assert not any("FileScan" in x for x in below[:end]), "\n".join(below[:end])


def test_relation_of_a_common_word_is_linear(spark):
    """400 meanings of one word, all asked about it: what is put side by side is no square of them."""
    n = 400
    ids = spark.range(n).select(F.concat(F.lit("s"), "id").alias("synset_id"), F.lit("e").alias("entry_id"), (F.col("id") + 1).cast("int").alias("rank"))
    entries = spark.createDataFrame([("e", "run", "run", "v"), ("f", "jog", "jog", "v")], "id string, lemma string, lemma_key string, pos string")
    edges = spark.range(1, n).select(F.concat(F.lit("s"), "id").alias("src"), F.lit("hypernym").alias("rel"), F.concat(F.lit("t"), "id").alias("dst"))
    asked = ids.select("synset_id").union(spark.createDataFrame([("t1",), ("u",)], "synset_id string")).select(F.col("synset_id").alias("synset"), F.explode(F.array(F.lit("run"), F.lit("jog"), F.lit("walk"))).alias("key"), F.lit("v").alias("pos"))
    senses = ids.union(spark.createDataFrame([("t1", "f", 1)], "synset_id string, entry_id string, rank int"))
    rows, most = most_rows(spark, graph.relation(asked, edges, entries, senses))
    got = {(r.synset, r.key): r.label for r in rows}
    want = {(f"s{i}", w): l for i in range(n) for w, l in (("run", "member"), ("jog", "hypernym" if i == 1 else "far"), ("walk", "unknown"))}
    want |= {("t1", "jog"): "member", ("t1", "run"): "far", ("t1", "walk"): "unknown", ("u", "jog"): "far", ("u", "run"): "far", ("u", "walk"): "unknown"}
    assert got == want and most < 8 * n


def test_best_meanings_are_those_of_all_pairs(spark):
    """400 groups of one headword with 300 meanings, beside others: verdicts of the table of all pairs, without that table."""
    import random

    from lexloom.operators import align

    draw, words = random.Random(7), ["oak", "oak tree", "elm", "tall elm", "ash-grey", "fir", "run", "of"]
    heads, groups, meanings, hood = [], [], [], []
    for head, pos, n, m in (("run", "v", 400, 300), ("run", None, 20, 30), ("tall elm", "n", 30, 1), ("lost", "n", 2, 0)):
        meanings += [(head, pos, f"{head}{pos}{i}", 3 * i) for i in range(m)]
        hood += [(f"{head}{pos}{i}", k, draw.choice([0.4, 0.5, 0.6, 0.8, 1.0])) for i in range(m) for k in draw.sample([*words, "tree", "tall"], 4)]
        for g in range(n):
            heads.append((f"{head}{pos}#{g}", head, pos))
            groups += [(f"{head}{pos}#{g}", draw.choice(["group", "group", "context", "name"]), w) for w in draw.sample(words, 4)]
    heads = spark.createDataFrame(heads, "group string, head string, pos string")
    groups = spark.createDataFrame(groups, "group string, role string, key string")
    meanings = spark.createDataFrame(meanings, "head string, pos string, target string, ord int")
    hood = spark.createDataFrame(hood, "synset string, key string, w double")
    keys = spark.createDataFrame([("run", "run"), ("elm", "elm"), ("elm", "oak"), ("fir", "fir")], "word string, key string")
    stop = spark.createDataFrame([("of",)], "key string")
    usable = heads.select("group", F.lit(12).alias("n"))
    pairs = heads.join(meanings.withColumnsRenamed({"head": "h", "pos": "p"}), (F.col("head") == F.col("h")) & F.col("pos").eqNullSafe(F.col("p"))).select("group", "target", "ord", "head")
    want = align.verdicts(heads, align.align_scores(groups, pairs, hood, keys, stop), usable).collect()
    rows, most = most_rows(spark, align.best_meanings(heads, groups, meanings, hood, keys, stop, usable))
    line = lambda r: (r.group, r.target, r.score, r.second, r.part, r.verdict)
    assert {r.group: line(r) for r in rows} == {r.group: line(r) for r in want} and len(rows) == len(want)
    assert spark.sparkContext._lexloom_shipped  # its Python runs in workers
    assert len({r.verdict for r in rows}) == 5 and most < 10_000


def test_counting_per_document_moves_texts_once(spark):
    """One exchange deals the texts out by id; the words that are cut from them are not sent again."""
    for name, exchanges in (("stop_filtered_tokens", 1), ("signature_top60", 1)):
        text = plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert len(re.findall(r"Exchange hashpartitioning", text)) == exchanges


def test_long_words_are_not_taken_apart(spark):
    """Words of 60 letters are near no query of eight: no deletions are made of them."""
    from lexloom.operators import search

    long = spark.range(100).select(F.concat(F.lit("b"), F.repeat(F.lit("olt"), 20), F.col("id").cast("string")).alias("key"))
    found, most = most_rows(spark, search.suggestions(spark.createDataFrame([("boltz",)], "query string"), long.union(spark.createDataFrame([("bolta",)], "key string"))))
    assert [(r.key, r.place) for r in found] == [("bolta", 1)] and most < 2_000
