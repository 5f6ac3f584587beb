"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word enters as a hashed word embedding and as the maximum over the embeddings
of its hashed four-grams and beginnings of UTF-8 bytes (with word ends).  Two gated recurrent layers read
a window of ``WINDOW`` words in both directions, attention pools their states, and a
logistic unit scores the window.  All windows of a text are scored, each overlapping
the next (the last one ends with the text); the highest is the text's score.

All weights and embeddings start at random numbers and learn from the labels alone.
Training sees at most about ``positives`` + ``negatives`` labelled rows, drawn by a
hash of the id, and of each at most ``windows`` windows, spread over the whole text;
they are cut where the rows lie, so that the driver never holds a text.  A text's label
is passed to its windows by an attention over their logits that sharpens from epoch to
epoch: at first all windows learn it, in the end the highest one (of harmless texts the
two highest).  Buckets that fewer than ``RARE`` texts of the sample hold stay zero, so
that single texts are not learned by heart.

Scoring is a map over the rows; each distinct word is embedded and projected once a
worker and batch of texts.  Defined results: null texts and texts without a letter or
digit score 0; several labels of one id count as toxic if one does; null labels and
ids train nothing; without a label of either kind every score is 0.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import tune

WINDOW, STRIDE = 128, 96
WORD_BUCKETS, CHAR_BUCKETS = 1 << 16, 1 << 15
SIZE, HIDDEN, ATTENTION = 8, 8, 8
POSITIVES, NEGATIVES = 800, 1600
#: Windows of one text that training sees, and letters of the longest word in them (longer ones are left out there).
WINDOWS, LONGEST = 16, 48
RATE, BATCH = 0.01, 64
#: Epochs: how sharply a text's label is given to its highest windows (0: all alike), and the step of the embeddings.
EPOCHS = ((0.0, 0.1), (0.0, 0.1), (1.0, 0.1), (2.0, 0.1), (4.0, 0.05), (4.0, 0.05), (8.0, 0.05), (8.0, 0.02), (16.0, 0.02))
LEAST_STEPS = 400
RARE = 4
#: Exponent of the loss that bounds the pull of mislabelled texts.
ROBUST = 0.4
THRESHOLD = 0.7
#: Distinct words that a worker keeps projected.
KEPT_WORDS = 1 << 17

_WORD = re.compile(r"[^\W_]+")


def split_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_bucket(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS


def char_buckets(word: str) -> list[int]:
    s = b"^" + word.encode("utf-8", "surrogatepass") + b"$"
    n = len(s)
    out = [crc32(s[i : i + 4], 7) % CHAR_BUCKETS for i in range(max(1, n - 3))]
    return out + [crc32(s[:i], 7) % CHAR_BUCKETS for i in range(5, min(8, n) + 1)]


def window_starts(n: int) -> list[int]:
    if n <= WINDOW:
        return [0]
    out = list(range(0, n - WINDOW, STRIDE))
    return out + [n - WINDOW]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Vocabulary:
    """Distinct words of a sample: their buckets, and the windows of texts as word numbers (-1 pads)."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.word: list[int] = []
        self.chars: list[list[int]] = []

    def ids(self, words: list[str]) -> np.ndarray:
        number, out = self.number, []
        for w in words:
            i = number.get(w)
            if i is None:
                i = number[w] = len(self.word)
                self.word.append(word_bucket(w))
                self.chars.append(char_buckets(w))
            out.append(i)
        return np.array(out, dtype=np.int32)

    def flat_chars(self):
        size = np.fromiter(map(len, self.chars), np.int64, len(self.chars))
        return np.concatenate([np.array(c, np.int32) for c in self.chars]), np.cumsum(size) - size


def windows_of(ids: np.ndarray) -> np.ndarray:
    if not len(ids):
        return np.zeros((0, WINDOW), np.int32)
    if len(ids) <= WINDOW:
        return np.concatenate((ids, np.full(WINDOW - len(ids), -1, np.int32)))[None]
    return ids[np.array(window_starts(len(ids)))[:, None] + np.arange(WINDOW)]


def cut_windows(text: str, most: int = WINDOWS) -> list[str]:
    """At most ``most`` windows of a text for training, evenly spread from its first to its last word."""
    words = split_words(text)
    if not words:
        return []
    starts = window_starts(len(words))
    if len(starts) > most:
        starts = [starts[round(i * (len(starts) - 1) / max(1, most - 1))] for i in range(most)]
    cut = (" ".join(w for w in words[a : a + WINDOW] if len(w) <= LONGEST) for a in starts)
    return [w for w in cut if w]


def new_model(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    r = lambda *s, k=0.3: rng.normal(0, k, s).astype(np.float32)
    m = {"words": r(WORD_BUCKETS, SIZE, k=0.1), "chars": r(CHAR_BUCKETS, SIZE, k=0.1)}
    for d in "fb":
        m |= {f"W{d}": r(2 * SIZE, 3 * HIDDEN), f"U{d}": r(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return m | {"A": r(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": r(ATTENTION), "w": r(2 * HIDDEN), "b": np.full(1, -1.0, np.float32)}


def recur(gates: np.ndarray, U: np.ndarray, live: np.ndarray, keep: bool):
    """States of one direction over (time, batch, 3H) input gates; with ``keep``, what the way back needs."""
    T, B, _ = gates.shape
    h, out, saved = np.zeros((B, HIDDEN), np.float32), np.empty((T, B, HIDDEN), np.float32), []
    whole = live.all()
    for t in range(T):
        u = h @ U
        zr = 1 / (1 + np.exp(-(gates[t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])))
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        if keep:
            saved.append((h, z, r, n, u[:, 2 * HIDDEN :]))
        h = new if whole else np.where(live[t][:, None], new, h)
        out[t] = h
    return out, saved


def pool(m, states, live):
    k = np.tanh(states @ m["A"] + m["a"])
    e = np.where(live, k @ m["v"], np.float32(-1e9))
    e = np.exp(e - e.max(axis=0))
    alpha = e / e.sum(axis=0)
    p = np.einsum("tb,tbh->bh", alpha, states)
    return p @ m["w"] + m["b"][0], (k, alpha, p)


def forward(m, gates_f, gates_b, live, keep=False):
    """Window logits; the backward direction gets its gates reversed in time."""
    sf, kf = recur(gates_f, m["Uf"], live, keep)
    sb, kb = recur(gates_b[::-1], m["Ub"], live[::-1], keep)
    states = np.concatenate((sf, sb[::-1]), axis=2)
    logit, kept = pool(m, states, live)
    return logit, (states, kf, kb, kept)


def recur_back(dstates, U, live, saved):
    """Gradients of gates and U from those of the states."""
    T, B, _ = dstates.shape
    dgates, dU, dh = np.empty((T, B, 3 * HIDDEN), np.float32), np.zeros_like(U), np.zeros((B, HIDDEN), np.float32)
    for t in range(T - 1, -1, -1):
        h, z, r, n, un = saved[t]
        dh = dh + dstates[t]
        on = live[t][:, None]
        d = np.where(on, dh, 0)
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        g = np.concatenate((dz, dr, dn), axis=1)
        du = np.concatenate((dz, dr, dn * r), axis=1)
        dgates[t] = g
        dU += h.T @ du
        dh = np.where(on, d * z + du @ U.T, dh)
    return dgates, dU


def gradients(m, x, live, label, weight=1.0):
    """Loss gradients of a batch of windows; x is (time, batch, 2 * SIZE)."""
    gf, gb = x @ m["Wf"] + m["cf"], x @ m["Wb"] + m["cb"]
    logit, (states, kf, kb, (k, alpha, p)) = forward(m, gf, gb, live, True)
    right = _sigmoid(np.where(label > 0, logit, -logit))
    # The further a label is from all evidence, the less it teaches: some labels are wrong.
    dl = ((right - 1) * np.where(label > 0, 1, -1) * right**ROBUST * weight).astype(np.float32) / len(label)
    g = {"w": p.T @ dl, "b": dl.sum(keepdims=True)}
    dp = dl[:, None] * m["w"]
    ds = alpha[:, :, None] * dp
    dalpha = np.einsum("bh,tbh->tb", dp, states)
    de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
    g["v"] = np.einsum("tb,tba->a", de, k)
    dk = de[:, :, None] * m["v"] * (1 - k * k)
    g["A"] = np.einsum("tbh,tba->ha", states, dk)
    g["a"] = dk.sum(axis=(0, 1))
    ds = ds + dk @ m["A"].T
    dgf, g["Uf"] = recur_back(ds[:, :, :HIDDEN], m["Uf"], live, kf)
    dgb, g["Ub"] = recur_back(ds[::-1, :, HIDDEN:], m["Ub"], live[::-1], kb)
    dgb = dgb[::-1]
    for d, dg in (("f", dgf), ("b", dgb)):
        g[f"W{d}"] = np.einsum("tbd,tbg->dg", x, dg)
        g[f"c{d}"] = dg.sum(axis=(0, 1))
    return logit, g, dgf @ m["Wf"].T + dgb @ m["Wb"].T


def embed(m, word: np.ndarray, chars: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.concatenate((m["words"][word], np.maximum.reduceat(m["chars"][chars], heads, axis=0)), axis=1)


def score_windows(m, gates: tuple[np.ndarray, np.ndarray], windows: np.ndarray, step: int = 2048) -> np.ndarray:
    """Logits from the projected words; row -1 of the gates is that of padding."""
    out = np.empty(len(windows), np.float32)
    for at in range(0, len(windows), step):
        ids = windows[at : at + step].T
        out[at : at + step] = forward(m, gates[0][ids], gates[1][ids], ids >= 0)[0]
    return out


def project(m, x):
    pad = np.zeros((1, 3 * HIDDEN), np.float32)
    return np.concatenate((x @ m["Wf"] + m["cf"], pad)), np.concatenate((x @ m["Wb"] + m["cb"], pad))


def train(texts: list[list[str]], labels: list[int], seed: int = 11) -> dict | None:
    """``texts``: per text its windows, each the words joined by blanks (see ``cut_windows``)."""
    keep = [i for i, t in enumerate(texts) if t]
    y = np.array([labels[i] for i in keep], np.int64)
    if not len(y) or y.min() == y.max():
        return None
    m, vocabulary = new_model(seed), Vocabulary()
    ids = [[vocabulary.ids(w.split(" ")) for w in texts[i]] for i in keep]
    word = np.array(vocabulary.word)
    chars, heads = vocabulary.flat_chars()
    common = {}
    for name, n, of in (("words", WORD_BUCKETS, lambda u: word[u]), ("chars", CHAR_BUCKETS, lambda u: np.concatenate([vocabulary.chars[i] for i in u]))):
        held = np.zeros(n, np.int64)
        for own in ids:
            held[np.unique(of(np.unique(np.concatenate(own))))] += 1
        common[name] = held >= RARE
        m[name][~common[name]] = 0
    size = np.array([len(own) for own in ids])
    windows = np.concatenate([windows_of(x) for own in ids for x in own])
    text = np.repeat(np.arange(len(y)), size)
    first = np.cumsum(size) - size
    # Both kinds weigh the same, however rare one of them is.
    kind = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum())).astype(np.float32)
    rng = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items() if k not in ("words", "chars")}
    square = {k: np.full((len(m[k]), 1), 1e-4, np.float32) for k in ("words", "chars")}
    step = 0
    again = max(1, -(-LEAST_STEPS * BATCH // (2 * len(y) * len(EPOCHS))))
    for sharp, embed_rate in np.repeat(np.array(EPOCHS), again, axis=0).tolist():
        share = np.ones(len(windows), np.float32)
        if sharp:
            s = score_windows(m, project(m, embed(m, word, chars, heads)), windows)
            share = np.exp(sharp * (s - np.maximum.reduceat(s, first)[text]))
        share /= np.add.reduceat(share, first)[text]
        pick = np.flatnonzero((share >= 0.02) & (share >= 0.5 / size[text]) | (rng.random(len(share)) < share))
        order = pick[rng.permutation(len(pick))]
        for at in range(0, len(order), BATCH):
            o = order[at : at + BATCH]
            label = y[text[o]].astype(np.float32)
            weight = share[o] * kind[text[o]]
            win = windows[o].T
            live = win >= 0
            used, place = np.unique(np.where(live, win, 0), return_inverse=True)
            own = [vocabulary.chars[i] for i in used]
            c = np.concatenate([np.array(z) for z in own])
            lens = np.array([len(z) for z in own])
            h = np.cumsum(lens) - lens
            xu = embed(m, word[used], c, h)
            xin = xu[place.reshape(win.shape)] * live[:, :, None]
            _, g, dx = gradients(m, xin, live, label, weight / weight.mean())
            dx = dx * live[:, :, None]
            step += 1
            for k, v in g.items():
                a, b = moment[k]
                a += 0.1 * (v - a)
                b += 0.001 * (v * v - b)
                m[k] -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            du = np.zeros_like(xu)
            np.add.at(du, place.reshape(-1), dx.reshape(-1, 2 * SIZE))
            dchar = np.where(m["chars"][c] == np.repeat(xu[:, SIZE:], lens, axis=0), np.repeat(du[:, SIZE:], lens, axis=0), 0)
            for name, rows, d in (("words", word[used], du[:, :SIZE]), ("chars", c, dchar)):
                rows, d = rows[common[name][rows]], d[common[name][rows]]
                r, of = np.unique(rows, return_inverse=True)
                total = np.zeros((len(r), SIZE), np.float32)
                np.add.at(total, of, d)
                square[name][r] += (total * total).mean(axis=1, keepdims=True)
                m[name][r] -= embed_rate * total / np.sqrt(square[name][r])
    return m


class Scorer:
    """Scores texts; projected words are kept between batches, up to a bound."""

    def __init__(self, model: dict | None):
        self.m = model
        self.reset()

    def reset(self):
        self.vocabulary, self.gates = Vocabulary(), [np.zeros((0, 3 * HIDDEN), np.float32)] * 2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.m is None:
            return out
        v, m = self.vocabulary, self.m
        had = len(v.word)
        windows = [windows_of(v.ids(split_words(t))) for t in texts]
        if len(v.word) > had:
            fresh = v.chars[had:]
            lens = np.array([len(c) for c in fresh])
            x = embed(m, np.array(v.word[had:]), np.concatenate([np.array(c) for c in fresh]), np.cumsum(lens) - lens)
            fwd, bwd = project(m, x)
            self.gates = [np.concatenate((old[: had], new)) for old, new in zip(self.gates, (fwd, bwd))]
        size = np.array([len(w) for w in windows])
        if size.sum():
            s = _sigmoid(score_windows(m, self.gates, np.concatenate(windows)))
            some = np.flatnonzero(size)
            out[some] = np.maximum.reduceat(s, (np.cumsum(size) - size)[some])
        if len(v.word) > KEPT_WORDS:
            self.reset()
        return out


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, windows: int = WINDOWS) -> dict | None:
    """Train on a bounded sample of ``labels`` (doc_id, toxic) with the texts of ``docs``."""
    tune(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg((F.max("toxic") > 0).cast("int").alias("l_toxic"))
    sizes = dict(known.groupBy("l_toxic").count().collect())
    draw = F.pmod(F.xxhash64("l_id"), F.lit(1 << 30))
    share = lambda n, most: int(min(1.0, most / max(1, n)) * (1 << 30))
    sample = known.filter(draw < F.when(F.col("l_toxic") == 1, share(sizes.get(1, 0), positives)).otherwise(share(sizes.get(0, 0), negatives)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")

    def cut(batches):
        for b in batches:
            wins = [cut_windows(t, windows) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(wins, pa.list_(pa.string())), b.column(2)], names=["doc_id", "windows", "toxic"])

    # The sample is bounded by its parameters, so it may be broadcast; its windows are bounded, too.
    rows = own.join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "l_toxic").mapInArrow(cut, "doc_id long, windows array<string>, toxic int").collect()
    rows = sorted((r.doc_id, r.windows, r.toxic) for r in rows)
    return train([r[1] for r in rows], [r[2] for r in rows])


def score_documents(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with score and predicted (columns of these names come out as score_input, predicted_input)."""
    tune(docs.sparkSession)
    own = docs.withColumnsRenamed({c: f"{c}_input" for c in ("score", "predicted") if c in docs.columns})
    at = own.columns.index("text")

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            texts = b.column(at).to_pylist()
            s = np.concatenate([scorer.scores(texts[i : i + 64]) for i in range(0, len(texts), 64)]) if texts else np.zeros(0)
            yield pa.record_batch([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    schema = T.StructType(list(own.schema.fields)).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return own.mapInArrow(run, schema)
