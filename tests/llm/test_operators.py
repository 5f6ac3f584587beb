"""The training-data operators against brute force on small hand-made tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexloom.llm import chat, common, decontaminate, language, licenses, mixing, quality, repeats, simhash, substring, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k int, score string, bucket string"
RNG = random.Random(5)
VOCABULARY = ["w%d" % i for i in range(400)]


def sentence(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


PASSAGE = sentence(60)


def corpus():
    texts = [sentence(RNG.randint(5, 150)) for _ in range(30)]
    texts += [sentence(20) + " " + PASSAGE + " " + sentence(RNG.randint(0, 30)) for _ in range(12)]
    texts += [PASSAGE, PASSAGE, PASSAGE + " tail", "", " \t\n ", "a", "é" * 60 + " " + "ab" * 300, "ab" * 400, sentence(9000), None, None]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), i, "x", "y") for i, t in enumerate(texts)]
    rows.append((None, PASSAGE + " " + sentence(10), None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None))
    return rows + [rows[31], rows[31], rows[43]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def distinct_rows():
    seen = {}
    for r in corpus_rows():
        seen.setdefault((r[0], r[1]), r)
    return list(seen)


_rows = []


def corpus_rows():
    return _rows


@pytest.fixture(scope="module", autouse=True)
def _remember(docs):
    _rows[:] = [tuple(r) for r in docs.collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_substring(docs, empty):
    count = Counter()
    rows = distinct_rows()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = Counter()
    for d, t, *_ in corpus_rows():
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[(d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter(map(tuple, substring.substring_digest(docs).collect())) == want
    assert substring.substring_digest(empty).collect() == []
    full = substring.substring_dedup(docs, carry=("source", "n_chars")).collect()
    assert len(full) == len(corpus_rows()) and {r.text for r in full if r.n_removed == 0} <= {r[1] for r in corpus_rows()}


def test_substring_hot_anchor(docs, monkeypatch):
    plain = sorted(map(str, substring.substring_digest(docs).collect()))
    monkeypatch.setattr(repeats, "HOT_LEAST", 2)
    monkeypatch.setattr(repeats, "HOT_SHARE", 0.0)
    assert sorted(map(str, substring.substring_digest(docs).collect())) == plain
    assert sorted(map(str, suffixes.suffix_digest(docs).collect())) == suffix_expected()


def suffix_expected():
    seen, out = set(), {}
    order = sorted(distinct_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for d, t in order:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(raw[i : i + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[(d, t)] = f"Row(doc_id={d}, n_bytes={len(raw)}, n_removed={sum(gone)}, n_spans={spans}, kept_sha256='{hashlib.sha256(kept).hexdigest()}')"
    return sorted(out[(r[0], r[1])] for r in corpus_rows())


def test_suffixes(docs, empty):
    assert sorted(map(str, suffixes.suffix_digest(docs).collect())) == suffix_expected()
    assert suffixes.suffix_digest(empty).collect() == []
    assert suffixes.suffix_dedup(docs).count() == len(corpus_rows())


def test_buckets_are_not_sorted(docs, monkeypatch):
    """Buckets go to Python as they come and in small batches; what a step writes has a file a block, not a bucket."""
    result = suffixes.suffix_digest(docs)
    files = list(Path(common._written[-1].removeprefix("file:")).glob("part-*.parquet"))
    assert 0 < len(files) <= 4 * docs.sparkSession.sparkContext.defaultParallelism
    assert not re.search(r"Sort \[bucket", result._jdf.queryExecution().toString())
    batches = repeats._table([(0, 0, i, bytes(300_000)) for i in range(20)]).to_batches()
    assert max(b.nbytes for b in batches) < 2 * repeats.BATCH_BYTES and sum(b.num_rows for b in batches) == 20
    assert repeats._table([]).to_batches() == []
    monkeypatch.setattr(repeats, "MOST_TASKS", 3)  # several buckets a task
    assert sorted(map(str, suffixes.suffix_digest(docs).collect())) == suffix_expected()


def test_runs_of_a_column():
    def run(*values):
        return pa.record_batch([pa.array(values, pa.int32()), pa.array(range(len(values)))], names=["bucket", "x"])

    called = []
    f = repeats.by_value("bucket", lambda t: called.append((t.column("bucket")[0].as_py(), t.num_rows)) or t)
    out = list(f(iter([run(), run(1, 1, 2), run(2), run(2, 3)])))
    assert called == [(1, 2), (2, 3), (3, 1)] and sum(b.num_rows for b in out) == 6
    assert list(f(iter([]))) == []


def test_deep_shallow_order():
    rng = np.random.default_rng(1)
    raw = bytes(rng.integers(97, 99, 3000, dtype=np.uint8)) + b"a" * 500 + b"ab" * 200
    start = rng.integers(0, len(raw) - 100, 800)
    group = np.sort(rng.integers(0, 3, 800))
    for shallow in (0, 8, 24, 96):
        order, equal = suffixes.deep_shallow_sort(raw, start, group, np.full(len(start), 100), shallow)
        strings = [(group[i], raw[start[i] : start[i] + 100]) for i in order]
        assert strings == sorted((g, raw[s : s + 100]) for g, s in zip(group, start))
        assert all((equal[i] == equal[i - 1]) == (strings[i] == strings[i - 1]) for i in range(1, len(order)))


@pytest.mark.parametrize("name", ["words", "bytes"])
@pytest.mark.parametrize("chunk", [2, 4096])
def test_method_decides_every_window(name, chunk, monkeypatch):
    """The steps of the substring operators without Spark: what goes is what the method returned, for equal slices, too."""
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    base = substring.Spec(35, 9, substring.word_hashes, substring.word_cutter, substring.compare_levels) if name == "words" else substring.Spec(100, 32, suffixes.byte_hashes, suffixes.byte_cutter, suffixes.compare_suffixes)
    said: set = set()

    def judge(r, texts, n, combine):
        (which, a, b), label = base.judge(r, texts, n, combine)
        said.update((int(r["did"][i]), int(r["lo"][i]) + j) for i, x, y in zip(which, a, b) for j in range(x, y + 1))
        return (which, a, b), label

    spec = repeats.Spec(base.n, base.k, base.tokens, base.cutter, judge)
    texts = [t or "" for _, t in sorted(distinct_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    sent = []
    for part in range(4):  # four tasks
        sender = repeats._Sender(spec, 3, np.zeros(0, np.uint64))
        for i in range(part, len(texts), 4):
            sender.add(i, i, 0, texts[i])
        sent += list(sender.flush())
    first = [r for b in range(3) for r in repeats.settle([x for x in sent if x[2] == b], spec, 3)]
    table = pa.table({"did": pa.array(range(len(texts)), pa.int64()), "k": pa.array(range(len(texts)), pa.int64()), "text": texts, "block": pa.array([0] * len(texts), pa.int32())})
    handed = repeats.hand_out(table, repeats._table([r for r in first if r[0] == 2]), spec, 3)
    second = [r for b in range(3) for r in repeats.decide([x for x in handed if x[2] == b], spec, 3)]
    r = repeats.unpack_all([x[3] for x in first + second if x[0] == 1])
    got = {(int(d), j) for d, lo, n in zip(r["did"], r["lo"], r["hi"]) for j in range(lo, lo + n + 1)}
    tokens = [words(t) if name == "words" else t.encode() for t in texts]
    seen, want, n = {}, set(), base.n
    for i, t in enumerate(tokens):
        for j in range(len(t) - n + 1):
            seen.setdefault(tuple(t[j : j + n]), []).append((i, j))
    for places in seen.values():
        want |= set(places if name == "words" and len(places) > 1 else places[1:])
    assert got == want == said and len(want) > 400


def test_simhash(spark, docs, empty):
    def fingerprint(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = [(r[0], fingerprint(r[1])) for r in corpus_rows()]
    values = sorted({f for _, f in prints})
    root = {f: f for f in values}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    want = Counter((d, f"{f:016x}", least.get(find(f))) for d, f in prints)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(empty).collect() == []
    from unittest import mock

    with mock.patch.object(simhash, "HOT_ROWS", 1):
        assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


@pytest.mark.parametrize("depth", [0, 3])
def test_vantage_points(spark, depth, monkeypatch):
    rng = np.random.default_rng(depth)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    values = list(base)
    for v in base[:60]:
        for _ in range(8):
            values.append(v ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 7)).astype(np.uint64)))
    a = np.unique(np.array(values, np.uint64))
    monkeypatch.setattr(simhash, "SHARD_POINTS", len(a) / 2**depth)
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    label = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    got = np.array([label.get(int(x), int(x)) for x in a.view(np.int64)])
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    want = np.arange(len(a))
    while True:
        new = np.array([want[n].min() for n in near])
        if (new == want).all():
            break
        want = new
    assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_quality(docs, empty):
    rows = corpus_rows()
    norm = lambda line: " ".join(words(re.sub("[1-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line))))
    held = {}
    for d, t, _, s, *_ in rows:
        for line in (t or "").split("\n"):
            if words(line):
                held.setdefault((s, norm(line)), set()).add(d if d is not None else (t,))
    for v in quality.line_verdicts(docs, max_share=0.0, least_docs=1).collect():
        t, s = next((r[1], r[3]) for r in rows if r[0] == v.doc_id and len(words(r[1])) == v.n_words)
        gone = sum(len(words(line)) for line in (t or "").split("\n") if len(held.get((s, norm(line)), ())) > 1)
        grams = [tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)]
        again = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(grams) < 2000 else set()
        assert v.n_removed_words == gone and v.n_repeat_words == len(again)
        failed = v.n_words < 10 or 100 * v.n_repeat_words > 20 * v.n_words
        assert v.base_failed == failed and v.kept == (not failed and not v.n_words - gone < 0.3 * v.n_words)
    assert quality.line_verdicts(docs).count() == len(rows)
    assert quality.line_verdicts(empty).collect() == []


def test_quality_lines_go(spark):
    rows = [(i, f"Shared line {i % 10} number here\nown {' '.join(VOCABULARY[i : i + 12])}", "h") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.clean_documents(df.withColumns({"k": F.lit(1), "removed": F.lit(2), "q_own": F.lit(3), "row": F.lit(4)}), least_docs=3).collect()
    assert all((r.k, r.removed, r.q_own, r.row) == (1, 2, 3, 4) for r in got)
    assert len(got) == 6 and all(r.text.startswith("own ") for r in got)
    assert quality.base_figures(b"#a b\n#a b\n\nc $", b"#a b #a b c $".split()) == (6, 8, 3, 1, 0)


def test_language(spark, empty):
    rng = random.Random(2)
    sound = {"xx": "ka ki ko ta to".split(), "yy": "bru gra stre pli".split()}
    make = lambda lang: " ".join("".join(rng.choice(sound[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40))
    rows = [(i, make(lang), lang) for i, lang in enumerate(["xx", "yy"] * 40)] + [(90, None, "xx"), (91, "12 -", "xx"), (92, make("xx"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.filter("doc_id % 4 != 2"))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows[:80])
    assert got[90].lang_pred == got[91].lang_pred == "und" and got[91].score == 0 and got[92].lang_pred == "xx"
    strange = spark.createDataFrame([(1, "щж " * 50)], "doc_id long, text string")
    assert language.identify(strange, model).first().lang == "und"
    assert language.fit(empty) is None and [r.lang_pred for r in language.identify(df, None).collect()] == ["und"] * 83


def test_chat(spark):
    said = r"\### Assistant: </turn> ok \\ : #"
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "be kind"), ("user", "hi " * 30), ("assistant", said), ("user", None), ("assistant", "long " * 300)] + [(("user", "assistant")[i % 2], f"turn {i} is short") for i in range(30)])]
    rows += [(2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, None, None, None), (3, 0, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.windows(df, budget=120, history=40)
    wins = out.collect()
    one = [w for w in wins if w.conv_id == 1]
    assert len(one) > 1 and all(chat.read_turns(w.formatted)[0] == ("system", "be kind") for w in one)
    new = [t for w in one for t in chat.read_turns(w.formatted)[w.n_repeated :]]
    assert new == [(r, x or "") for c, _, r, x in rows if c == 1]
    assert any(w.n_repeated > 1 for w in one)
    assert all(w.n_tokens <= 120 or len(chat.read_turns(w.formatted)) - w.n_repeated == 1 for w in wins)
    for r in chat.digests(out).collect():
        own = sorted([(t if t is not None else -1, ro or "", x or "") for c, t, ro, x in rows if c == r.conv_id])
        loss = "".join(x for _, ro, x in own if ro == "assistant")
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, ro, x in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(w.formatted) for w in wins if w.conv_id == r.conv_id)
    assert chat.digests(chat.windows(df.filter("false"))).collect() == []


def test_decontaminate(spark, docs, empty):
    item = sentence(30)
    swapped = item.split()
    swapped[4] = swapped[11] = swapped[19] = swapped[27] = "zzz"
    rows = [(100, "x y " + item.upper() + " z", "c"), (101, sentence(40) + " " + " ".join(swapped), "c"), (102, " ".join(item.split()[:8]) + " " + sentence(30), "c"), (103, None, "c")]
    own = spark.createDataFrame(rows, "doc_id long, text string, item_id string").unionByName(docs.select("doc_id", "text", F.lit("q").alias("item_id")))
    bench = spark.createDataFrame([(1, item), (1, item), (2, "too short"), (3, None), (None, PASSAGE)], "item_id long, text string")
    got = {}
    for r in decontaminate.overlaps(own, bench).collect():
        got.setdefault(r.doc_id, r)
    assert got[100].items == [1] and got[101].items == [1] and got[102].items == [] and got[103].items == []
    brute = {d for d, t, *_ in corpus_rows() if t and PASSAGE in t}
    assert {d for d, r in got.items() if r.items != [] and d not in (None, 100, 101)} == brute - {None}
    clash = own.withColumns({"b_key": F.lit(1), "k": F.lit(2), "h_id": F.lit(3), "row": F.lit(4), "hits": F.lit(5)})
    assert {r.doc_id for r in decontaminate.decontaminate(clash, bench).collect()} == {r.doc_id for r in decontaminate.decontaminate(own, bench).collect()}
    kept = decontaminate.decontaminate(own, bench)
    assert kept.count() == own.count() - 2 - sum(1 for r in corpus_rows() if r[1] and PASSAGE in r[1])
    assert decontaminate.overlaps(empty, bench).collect() == [] and decontaminate.decontaminate(own, bench.limit(0)).count() == own.count()


def test_mixing(spark, docs, empty):
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(corpus_rows())
    total = Counter()
    for r in plan:
        total[r.source] += r["size"]
        assert r["size"] == len(words(next(x[1] for x in corpus_rows() if x[0] == r.doc_id and len(words(x[1])) == r["size"])))
    targets = {r.source: r.target for r in plan}
    want = 1.5 * sum(total.values())
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, [5, 2, 1] * 3))
    open_, given = set(names), {}
    while True:
        left = want - sum(given.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            break
        given |= {s: 2.0 * total[s] for s in full}
        open_ -= full
    assert all(abs(targets[s] - (given | share)[s]) < 1e-6 * want for s in names)
    assert all(r.copies <= 2 and r.taken == r.copies * r["size"] for r in plan)
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == sorted(map(str, plan))
    assert mixing.mix_documents(docs).count() == sum(r.copies for r in plan)
    assert mixing.mix_plan(empty).collect() == []


def test_mixing_salted(docs, monkeypatch):
    plain = sorted(map(str, mixing.mix_plan(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == plain


def test_toxicity(spark, empty):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        w = [rng.choice(VOCABULARY) for _ in range(rng.randint(5, 300))]
        bad = i % 3 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["grmbl", "fnork", "blargh"])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(bad)))
    rows += [(400, None, "x"), (401, "", "x"), (402, "... !", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    model = toxicity.fit(df, lab.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    got = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    right = [got[i].predicted == y for i, y in labels if held(i)]
    assert sum(right) / len(right) > 0.95
    assert got[400].score == got[401].score == got[402].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.fit(df, lab.filter("toxic = 0")) is None
    assert all(r.score == 0 for r in toxicity.score_documents(df, None).collect())
    assert toxicity.score_documents(empty, model).collect() == []


def plain_score(m, text):
    """The network once more, a word and a gate at a time."""
    said = re.findall(r"[^\W_]+", (text or "").lower())
    if not said:
        return 0.0
    sig = lambda x: 1 / (1 + np.exp(-x))

    def entry(w):
        raw = b"^" + w.encode() + b"$"
        places = [zlib.crc32(raw[i : i + 4], 7) for i in range(max(1, len(raw) - 3))] + [zlib.crc32(raw[:i], 7) for i in range(5, min(8, len(raw)) + 1)]
        letters = [m["chars"][c % len(m["chars"])] for c in places]
        return np.concatenate((m["words"][zlib.crc32(w.encode()) % len(m["words"])], [max(v[j] for v in letters) for j in range(len(letters[0]))]))

    def walk(xs, d):
        h, out = np.zeros(toxicity.HIDDEN), []
        for x in xs:
            gate, own, n = x @ m["W" + d] + m["c" + d], h @ m["U" + d], toxicity.HIDDEN
            z, r = sig(gate[:n] + own[:n]), sig(gate[n : 2 * n] + own[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(gate[2 * n :] + r * own[2 * n :])
            out.append(h)
        return out

    best, last = -np.inf, max(0, len(said) - 128)
    for at in sorted({*range(0, last, 96), last}):
        xs = [entry(w) for w in said[at : at + 128]]
        states = [np.concatenate(p) for p in zip(walk(xs, "f"), walk(xs[::-1], "b")[::-1])]
        weight = np.exp([np.tanh(s @ m["A"] + m["a"]) @ m["v"] for s in states])
        best = max(best, sum(w * (s @ m["w"]) for w, s in zip(weight / weight.sum(), states)) + m["b"][0])
    return sig(best)


def test_toxicity_scores_by_hand(spark):
    rng = random.Random(8)
    m = toxicity.new_model(5)
    m = {k: (v + np.random.default_rng(3).normal(0, 0.3, v.shape)).astype(np.float32) for k, v in m.items()}
    texts = [" ".join(rng.choice(VOCABULARY + ["élan", "x" * 70]) for _ in range(n)) for n in (1, 3, 127, 128, 129, 224, 225, 400, 5000)] + [None, "", "_ !", "Ab ab AB"]
    df = spark.createDataFrame([(i % 4, t, "a", 7) for i, t in enumerate(texts + texts[:2])], "doc_id long, text string, score string, predicted int")
    got = toxicity.score_documents(df, m).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert abs(r.score - plain_score(m, r.text)) < 1e-4 and r.predicted == int(r.score >= 0.7)
    assert toxicity.cut_windows("a " * 5000, 16)[-1].split() == ["a"] * 128 and len(toxicity.cut_windows("b " * 5000, 16)) == 16
    assert toxicity.cut_windows("", 4) == toxicity.cut_windows("y" * 60, 4) == []


def test_toxicity_learns_from_labels(spark):
    """Held-out rows of sf0.1: the trained network, the same network before training, and one trained on shuffled labels."""
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    asked = [(r.text, r.toxic) for r in docs.join(labels.filter(held), "doc_id").select("text", "toxic").collect()]

    def auc(model):
        p = np.concatenate([toxicity.Scorer(model).scores([t for t, _ in asked[i : i + 64]]) for i in range(0, len(asked), 64)])
        y = np.array([y for _, y in asked])
        above = (p[y == 1][:, None] > p[y == 0][None, :]) + 0.5 * (p[y == 1][:, None] == p[y == 0][None, :])
        return above.mean()

    assert auc(toxicity.fit(docs, labels.filter(~held))) >= 0.95
    assert auc(toxicity.new_model(11)) < 0.8
    mixed = labels.filter(~held).select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0).cast("int").alias("toxic"))
    assert auc(toxicity.fit(docs, mixed, 100, 200)) < 0.8


def test_network_gradients():
    """Analytic gradients against differences."""
    m = {k: v.astype(np.float64) for k, v in toxicity.new_model(1).items()}
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 4, 2 * toxicity.SIZE))
    live = np.ones((5, 4), bool)
    live[3:, 1] = False
    label = np.array([1.0, 0, 1, 0])
    toxicity_robust, toxicity.ROBUST = toxicity.ROBUST, 0.0
    try:
        _, g, _ = toxicity.gradients(m, x * live[:, :, None], live, label)

        def loss():
            logit, _ = toxicity.forward(m, x * live[:, :, None] @ m["Wf"] + m["cf"], x * live[:, :, None] @ m["Wb"] + m["cb"], live)
            p = 1 / (1 + np.exp(-logit))
            return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

        for name in ("Wf", "Ub", "A", "v", "w", "cb"):
            i = tuple(0 for _ in m[name].shape)
            old, step = m[name][i], 1e-2
            m[name][i] = old + step
            up = loss()
            m[name][i] = old - step
            down = loss()
            m[name][i] = old
            assert abs((up - down) / (2 * step) - g[name][i]) < 2e-3
    finally:
        toxicity.ROBUST = toxicity_robust


def license_names(scanner, text):
    return sorted({s[0] for block in licenses.scan_text(scanner, text) for s in block if s[0]})


def test_licenses(spark, docs, empty):
    text = licenses.TEXTS
    cases = [
        ("Some prose here.\nReleased under the MIT License.\nMore.", ["MIT"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("No terms at all.", []),
        (None, []),
        ("", []),
        ("We talked about a license to fish in the lake with the old man yesterday.", []),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Copyright 2019 Acme. All rights reserved.", ["Proprietary"]),
        ("Licensed under the MIT or Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
        ("Licensed under the Eclipse Public License 2.0.", ["EPL-2.0"]),
        ("Licensed under the EUPL, Version 1.2.", ["EUPL-1.2"]),
        ("Licensed under the Foo Public License 2.0.", []),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("Licensed under the GNU General Public License, version 4.", []),
        ("Er kam mit der Lizenz.", []),
        ("The MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + text["MIT"][0].replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE"), ["MIT"]),
        ("Copyright (c) 2020 Jane Doe\n" + text["ISC"][0], ["ISC"]),
        (text["0BSD"][0], ["0BSD"]),
        ("Copyright (c) 2021, X. All rights reserved.\n" + text["BSD-3-Clause"][0], ["BSD-3-Clause"]),
        ("Copyright (c) 2021, X. All rights reserved.\n" + text["BSD-2-Clause"][0], ["BSD-2-Clause"]),
        ("Released under the MIT License and " + "then the people walk by the river " * 4, ["MIT"]),
        ("prose " * 5000 + ". " + text["Zlib"][0], ["Zlib"]),
    ]
    rows = [(i, t, "x", i) for i, (t, _) in enumerate(cases)] + [(0, cases[0][0], "x", 0)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, licenses string, gain int")).collect()
    assert len(got) == len(rows) and all(r.licenses == cases[r.doc_id][1] for r in got), [(cases[r.doc_id][0][:60], r.licenses) for r in got if r.licenses != cases[r.doc_id][1]]
    assert licenses.scan_licenses(docs).count() == len(corpus_rows()) and licenses.scan_licenses(empty).collect() == []


def test_licenses_found_and_not_confused():
    """All texts with every twentieth word replaced and all statements, inside prose: recall, and nothing else named."""
    rng = random.Random(4)
    common = "river stone quiet morning people walk garden market paper window train letter between yellow music".split()
    prose = lambda n: " ".join(rng.choice(common) for _ in range(n)).capitalize() + "."
    scanner, asked, hits, wrong = licenses.Scanner(), 0, 0, []
    for name, texts in licenses.TEXTS.items():
        for words in ([*t.split()] for t in texts for _ in range(4)):
            for i in rng.sample(range(len(words)), len(words) // 20):
                own = set(licenses.word_list(words[i]))
                words[i] = words[i] if own & scanner.telling or len(words) < 9 else rng.choice(common)
            lines = ["\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width)) for width in (rng.choice((9, 14, 10_000)),)]
            got = license_names(scanner, f"{prose(30)}\n\n{lines[0]}\n\n{prose(40)}")
            asked, hits = asked + 1, hits + (name in got)
            wrong += [(name, g) for g in got if g != name]
    for name, called in licenses.NAMES.items():
        for said in (f"{prose(20)} {opening} the {c}. {prose(20)}" for c in called for opening in licenses.OPENINGS[:-1]):
            got = license_names(scanner, said)
            asked, hits = asked + 1, hits + (name in got)
            wrong += [(said, g) for g in got if g != name]
    assert hits >= 0.99 * asked and len(wrong) <= 0.005 * asked, (asked, hits, wrong[:5])


def test_license_ranks_by_size_alone():
    """The compressed sizes rank the right template first; equal ranks go to the first name."""
    scanner = licenses.Scanner({"ZZZ": licenses.TEXTS["MIT"], "AAA": ["nothing of the kind"]})
    for name in ("MIT", "ISC", "MPL-2.0", "Unlicense", "GPL-3.0"):
        ranked = scanner.gains(licenses.TEXTS[name][0][:600])
        tied = [scanner.names[i] for g, i in ranked if g >= ranked[0][0] - licenses.CLOSE]
        assert name in tied
    assert license_names(scanner, licenses.TEXTS["MIT"][0]) == ["MIT"]


def test_decontaminate_without_seeds(spark):
    """Every tolerated pattern of replaced words at 1 to 14 words, and patterns beyond, against a comparison of all places."""
    from itertools import combinations

    bench, rows = [], []
    for n in range(1, 15):
        item = [f"i{n}x{j}" for j in range(n)]
        bench.append((n, " ".join(item)))
        for hidden in (h for k in range(4) for h in combinations(range(n), k)):
            own = ["zzz" if j in hidden else w for j, w in enumerate(item)]
            rows.append((len(rows), "p q " + " ".join(own) + " r", n, hidden))
    rows.append((len(rows), "i13x2 i13x3 i13x4 i13x5 i13x6 i13x7 i13x8 i13x9 i13x10 i13x11 i13x12 at the start", 13, (0, 1)))

    def brute(n, hidden):
        w = min(13, n)
        return any(sum(j not in hidden for j in range(s, s + w)) / w >= 0.8 for s in range(n - w + 1))

    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.overlaps(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {i: [n] if brute(n, hidden) else [] for i, _, n, hidden in rows}


def test_decontaminate_salted(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(7, PASSAGE), (8, PASSAGE[:40])], "item_id long, text string")
    plain = sorted(map(str, decontaminate.overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "KNOWN_SEEDS", -1)
    assert sorted(map(str, decontaminate.overlaps(docs, bench).collect())) == plain
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", -1)
    monkeypatch.setattr(decontaminate, "VOCABULARY", 3)
    assert sorted(map(str, decontaminate.overlaps(docs, bench).collect())) == plain


def test_decontaminate_recall(spark):
    """Random passages of items with words replaced, inside prose, against an aligner that compares all places."""
    rng = random.Random(9)
    bench = [[rng.choice(VOCABULARY[:60]) for _ in range(rng.randint(3, 40))] for _ in range(25)]
    rows = []
    for i in range(300):
        own = rng.choice(bench)
        a = rng.randrange(len(own))
        part = [w if rng.random() > 0.17 else rng.choice(VOCABULARY[:60]) for w in own[a : a + rng.randint(3, 40)]]
        rows.append((i, [rng.choice(VOCABULARY[:60]) for _ in range(rng.randint(0, 30))] + part + [rng.choice(VOCABULARY[:60]) for _ in range(rng.randint(0, 9))]))

    def brute(doc, item):
        width, best = min(13, len(item)), 0
        for d in range(-len(item), len(doc)):
            equal = [0 <= d + j < len(doc) and doc[d + j] == w for j, w in enumerate(item)]
            best = max(best, max(sum(equal[s : s + width]) for s in range(len(item) - width + 1)) / width)
        return best >= 0.8

    want = {i: [n for n, item in enumerate(bench) if brute(doc, item)] for i, doc in rows}
    asked = spark.createDataFrame([(i, " ".join(d)) for i, d in rows], "doc_id long, text string")
    got = decontaminate.overlaps(asked, spark.createDataFrame([(n, " ".join(b)) for n, b in enumerate(bench)], "item_id long, text string")).collect()
    got = {r.doc_id: r["items"] for r in got}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {} and sum(map(bool, want.values())) > 50


def plain_counts(text):
    """The n-gram counts once more, letter by letter."""
    keep, low = [], (text or "").lower()
    for i, c in enumerate(low):
        if c.isalpha():
            keep.append(ord(c))
        elif i and low[i - 1].isalpha():
            keep.append(0)
    s, out, full = [0, *keep, 0], Counter(), 0xFFFFFFFF
    k = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D]
    one = [c * k[0] & full for c in s]
    two = [((a ^ a >> 15) * k[1] + c * k[2]) & full for a, c in zip(one, s[1:])]
    three = [((a ^ a >> 13) * k[2] + b) & full for a, b in zip(two, one[2:])]
    for h in one[1:-1] + two + three:
        out[((h ^ h >> 16) * k[1] & full) >> 20] += 1
    return out if any(keep) else None


def test_language_by_hand(spark):
    """Predictions against a plain cosine of plain counts; ties, repeated rows, a very long text."""
    import math

    rng = random.Random(12)
    make = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))
    kinds = {"aa": "abcdeé", "bb": "cdefgh", "cc": "ghijßk"}
    rows = [(i, make(kinds[lang], rng.randint(3, 60)), lang) for i, lang in enumerate([*kinds] * 30)]
    rows += rows[:2] + [(200, make("abcdeé", 40_000), "aa"), (201, "Ab1 c-d", "bb"), (202, "", "aa"), (203, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, per_language=20)
    df_of, n = Counter(), 0
    for _, t, lang in rows:
        c = plain_counts(t) if lang else None
        if c is not None:
            n += 1
            df_of.update(c.keys())
    idf = [math.log((n + 1) / (df_of[j] + 1)) + 1 for j in range(language.DIM)]
    assert max(abs(a - b) for a, b in zip(idf, model["idf"])) < 1e-5
    for r in language.identify(df, model).collect():
        c = plain_counts(next(t for i, t, _ in rows if i == r.doc_id))
        if c is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = {j: math.log1p(x) * idf[j] for j, x in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x / size * m[j] for j, x in v.items()) for m in model["centers"]]
        assert abs(r.score - max(cos)) < 1e-4
        near = {model["langs"][j] for j, x in enumerate(cos) if x >= max(cos) - 1e-5}
        assert r.lang_pred in near
    twin = model | {"langs": ["zz", "yy"], "centers": np.stack([model["centers"][0]] * 2), "limits": model["limits"][:2]}
    assert {r.lang_pred for r in language.identify(df.filter("doc_id < 9"), twin).collect()} == {"zz"}  # ties: the first centroid


def test_mixing_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", 5, "m", 1), (None, None, None, 6, "n", 2), (2, "", "t", 7, "o", 3)], "doc_id long, text string, source string, copy int, mix_size string, mix_plan int")
    got = mixing.mix_documents(df).collect()
    assert got and all(r.copy_input in (5, 6, 7) and r.mix_size in "mno" and r["mix_plan"] in (1, 2, 3) for r in got)


def test_quality_counts_short_lines(spark):
    rows = [(i, "Read more\nMenu\n" + ("Contact us\n" * 5 if i == 0 else " ".join(f"u{i}x{j}" for j in range(12))), "h") for i in range(50)]
    rows += [(50 + i, "Contact us\n" * 6 + "Read more", "h") for i in range(45)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.line_verdicts(df, least_docs=40).collect()}
    from unittest import mock

    with mock.patch.object(quality, "BROADCAST_LINES", -1):
        assert sorted(map(str, quality.line_verdicts(df, least_docs=40).collect())) == sorted(map(str, got.values()))
    assert got[1].removed == [0, 1] and got[1].n_removed_words == 3 and got[1].kept
    assert got[60].depleted and not got[60].kept


def test_language_trains_every_value(spark):
    rng = random.Random(2)
    langs = {f"l{i:03}": [chr(0x4E00 + 12 * i + j) for j in range(12)] for i in range(210)}
    text = lambda letters: " ".join("".join(rng.choices(letters, k=4)) for _ in range(20))
    rows = [(i, text(letters), lang) for i, (lang, letters) in enumerate(x for x in langs.items() for _ in range(2))]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model["langs"]) == set(langs)
    asked = spark.createDataFrame([(i, text(letters)) for i, letters in enumerate(langs.values())], "doc_id long, text string")
    hits = sum(r.lang_pred == f"l{r.doc_id:03}" for r in language.identify(asked, model).collect())
    assert hits > 200
