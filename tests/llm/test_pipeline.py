"""The pipeline's stages on the smallest tables, each held against its input."""

import hashlib
import os
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import mixing, queries, simhash, substring, suffixes, toxicity
from lexloom.llm.common import row_key

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DIR)
        rows = docs.collect()
        out.append(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "mixing"]


def test_stages(spark, stages):
    first, clean, single, cut, safe, mixed = stages
    assert 0.7 * len(first) < len(clean) <= len(first)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(clean)).collect()}
    assert sorted(r.doc_id for r in single) == sorted({groups[r.doc_id] for r in clean})
    want = {r.doc_id: r for r in substring.substring_dedup(spark.createDataFrame(single)).collect()}
    assert {r.doc_id: r.text for r in cut} == {d: r.text for d, r in want.items() if r.n_removed == 0 or r.n_removed < r.n_words}
    assert all(r.n_chars == len(r.text) for r in cut)
    bench = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert not any(b in r.text for r in safe for b in bench)
    assert {r.doc_id for r in cut if any(b in r.text for b in bench)}.isdisjoint(r.doc_id for r in safe)
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(spark.createDataFrame(safe)).collect()}
    assert len(mixed) == sum(plan.values())
    assert all(set(corpus_pipeline.COLUMNS) == set(rows[0].asDict()) for rows in stages[:-1])


def test_every_query_runs(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    for name in ("op2_language_id", "op6_license_scan", "op3_chat_windows"):
        assert queries.QUERIES[name](spark, DIR).count() > 0
    assert suffixes.LENGTH == 100


def test_near_copies_without_or_with_shared_ids(spark):
    import random

    rng = random.Random(11)
    text = lambda: " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(900)) for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c), (3, c), (7, d), (7, e), (7, e), (2, e), (9, f)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, DIR).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (3, c), (7, d), (2, e), (9, f)], key=str)


RNG = random.Random(21)
PLAIN = ["p%d" % i for i in range(300)]
BAD = ["grmbl", "fnork", "blargh"]
ITEM = " ".join(RNG.choice(PLAIN) for _ in range(25))
PASSAGE = " ".join(RNG.choice(PLAIN) for _ in range(45))


def said(n, *bad):
    w = [RNG.choice(PLAIN) for _ in range(n)]
    for b in bad:
        w[RNG.randrange(n)] = b
    return " ".join(w)


def nasty():
    """(doc_id, text, lang, source, n_chars) with nulls in every column, shared ids, repeated rows, empty and long texts, copies, passages, items, toxic words."""
    rows = [(i, said(RNG.randint(20, 160), *([RNG.choice(BAD)] * 3 if i % 3 == 0 else [])), "en", f"s{i % 4}", 1) for i in range(240)]
    texts = [said(30) + " " + PASSAGE + " " + said(20) for _ in range(6)] + [said(20) + " " + ITEM.upper() + " " + said(9), said(9) + " " + ITEM.replace("p1", "zz", 1), PASSAGE, said(6000), said(4000, *BAD * 200)]
    near = said(120).split()
    texts += [" ".join(near), " ".join(near[:60] + ["changed"] + near[61:]), " ".join(near) + " more"]
    rows += [(1000 + i, t, None if i % 2 else "en", "s1" if i % 3 else None, None) for i, t in enumerate(texts)]
    rows += [(None, said(40), None, None, None), (None, said(40), "xx", "s2", 4), (None, None, None, None, None), (2000, None, "en", "s3", 0), (2001, "", "en", "s3", 0), (2002, " \n\t", "en", "only", 3)]
    rows += [(7, said(50), "en", "s1", 9), (7, said(50), "en", "s1", 9), rows[1], rows[1], rows[250], rows[250], (3000, rows[4][1], "en", "s9", 2), (None, rows[5][1], "en", "s9", 2)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k int, copy string, score int, row string, block int, mix_plan int"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain(rows):
    return Counter(tuple(r)[:5] for r in rows)


def test_stages_against_brute_force(spark, tmp_path):
    rows = nasty()
    docs = spark.createDataFrame([(*r, 1, "c", 2, "r", 3, 4) for r in rows], SCHEMA).repartition(3)
    base = str(tmp_path)
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    back = lambda r: spark.createDataFrame([tuple(x) for x in r], "doc_id long, text string, lang string, source string, n_chars long")

    labels = spark.read.parquet(f"{base}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    one = stages["toxicity"](spark, docs, base).collect()
    assert plain(one) == Counter(r for r in rows if scorer.scores([r[1]])[0] < 0.7) and 60 <= len(rows) - len(one) <= 100

    two = stages["simhash_near_dedup"](spark, back(one), base).collect()
    keys = {(r.doc_id, r.text): r.key for r in back(one).select("doc_id", "text", row_key().alias("key")).collect()}
    prints = {r: fingerprint(r[1]) for r in plain(one)}
    values = sorted(set(prints.values()))
    root = {v: v for v in values}
    for _ in values:
        new = {a: min(root[b] for b in values if (a ^ b).bit_count() <= 4) for a in values}
        if new == root:
            break
        root = new
    first = {}
    for r, f in prints.items():
        first.setdefault(root[f], []).append(r)
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0, keys[r[:2]])) for g in first.values()]
    assert {tuple(r)[:2] for r in two} == {r[:2] for r in want} and len(two) == len(want)

    three = stages["substring_dedup"](spark, back(two), base).collect()
    seen = Counter(tuple(words(t)[i : i + 35]) for _, t, *_ in {tuple(r)[:2]: tuple(r) for r in two}.values() for i in range(len(words(t)) - 34))
    cut = Counter()
    for r in two:
        w = words(r.text)
        gone = {i + j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(35)}
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        if not gone:
            cut[tuple(r)] += 1
        elif left:
            cut[r.doc_id, left, r.lang, r.source, len(left)] += 1
    assert plain(three) == cut and any(len(r.text or "") < 400 and "p" in (r.text or "") for r in three)

    four = stages["benchmark_decontamination"](spark, back(three), base).collect()
    item = ITEM.split()

    def leaks(t):
        doc = re.findall(r"[^\W_]+", (t or "").lower())
        equal = lambda d: [0 <= d + j < len(doc) and doc[d + j] == w for j, w in enumerate(item)]
        return any(sum(e[s : s + 13]) >= 0.8 * 13 for e in map(equal, range(-len(item), len(doc))) for s in range(len(item) - 12))

    assert plain(four) == Counter(r for r in plain(three).elements() if not leaks(r[1])) and 1 <= len(three) - len(four) <= 2

    five = stages["mixing"](spark, back(four), base).collect()
    total = Counter()
    for r in four:
        total[r.source] += len(words(r.text))
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, open_, given = dict(zip(names, [5, 2, 1] * 9)), set(names), {}
    while True:
        left = 1.5 * sum(total.values()) - sum(given.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            break
        given |= {s: 2.0 * total[s] for s in full}
        open_ -= full
    want = Counter()
    for r in four:
        rate = (given | share)[r.source] / total[r.source] if total[r.source] else 0
        name = str(r.doc_id) if r.doc_id is not None else "null:" + (r.text or "")
        draw = int(hashlib.md5(f"mix-1:{name}".encode()).hexdigest()[:13], 16) / 2**52
        want[tuple(r)] += int(rate) + (draw < rate % 1)
    assert plain(five) == +want and five[0].copy >= 1

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), base).collect() == [], name
        assert stage(spark, docs, base).count() > 0, name
    assert plain(corpus_pipeline.run(spark, base).collect()) == plain(five) == plain(corpus_pipeline.run(spark, base).collect())
