"""Language identification by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed letter n-grams (1 to 3, blanks
between words included).  The document frequencies cover every training row; the
centroids, several per language, come from spherical k-means on at most about
``per_language`` training rows of each language, taken by a hash of the id; each
language is fitted in its own task, however many there are, and the driver and every
task hold 64 KB of centroids a language.  A text
takes the language of the centroid with the highest cosine; it is rejected if it
lies farther from that centroid than ``slack`` times the distance within which
nearly all (``quantile``) of its training rows lie.

Defined results: null texts and texts without a letter give ``und`` with score 0;
without any training row everything is ``und``; rows with null language or id train
nothing; equal texts get equal results.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import tune

DIM = 1 << 12
PER_LANGUAGE = 600
CENTROIDS = 4
ROUNDS = 8
QUANTILE = 0.995
SLACK = 1.25
UNKNOWN = "und"

_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams, or None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letter_table()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(0))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate(([np.uint32(0)], c[keep], [np.uint32(0)]))
    one = c * _K[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _K[1] + c[1:] * _K[2]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _K[2] + one[2:]
    h = np.concatenate((one[1:-1], two, three))
    h ^= h >> np.uint32(16)
    h *= _K[1]
    return np.bincount(h >> np.uint32(20), minlength=DIM)


def vector(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count) * idf
    return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Rows holding each n-gram, over all rows; what reaches the driver has the size of the table of n-grams."""

    def run(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                c = counts(text)
                if c is not None:
                    df += c > 0
                    n += 1
        yield pa.record_batch([pa.array(np.arange(DIM + 1, dtype=np.int32)), pa.array(np.append(df, n))], names=["i", "n"])

    out = np.zeros(DIM + 1, np.int64)
    for i, n in train.select("text").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n")).collect():
        out[i] = n
    return out[:DIM], int(out[DIM])


def k_means(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    """Spherical k-means, started far apart."""
    at = [int(rng.integers(len(x)))]
    near = x @ x[at[0]]
    while len(at) < min(k, len(x)):
        at.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[at[-1]])
    c = x[at]
    for _ in range(rounds):
        of = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[of == j].sum(axis=0) if (of == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 3) -> dict | None:
    """``train``: doc_id, text, lang."""
    tune(train.sparkSession)
    train = train.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = train.groupBy(F.col("lang").alias("s_lang")).agg(F.count(F.lit(1)).alias("size"))
    df, n = document_frequencies(train)
    idf = np.log((n + 1) / (df + 1)) + 1
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30))
    chosen = train.join(F.broadcast(sizes), F.col("lang") == F.col("s_lang")).filter(draw < F.least(F.lit(1.0), F.lit(per_language) / F.col("size")) * (1 << 30))

    def counted(batches):
        for b in batches:
            own = [counts(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(2), pa.array([None if c is None else c.astype(np.int32).tobytes() for c in own], pa.binary())], names=["doc_id", "lang", "counts"])

    def one(key, rows):
        # Counts, not texts, come here: 16 KB a row.
        own = sorted((i, c) for i, c in zip(rows.column("doc_id").to_pylist(), rows.column("counts").to_pylist()))
        lang, x = key[0].as_py(), [vector(np.frombuffer(c, np.int32), idf) for _, c in own]
        centers, limits = [], []
        if x:
            x = np.stack(x)
            c = k_means(x, CENTROIDS, ROUNDS, np.random.default_rng([seed, zlib.crc32(lang.encode("utf-8", "surrogatepass"))]))
            cos = x @ c.T
            of = np.argmax(cos, axis=1)
            for j in range(len(c)):
                far = 1 - cos[of == j, j]
                centers.append(c[j].astype(np.float32).tobytes())
                limits.append(float(np.quantile(far, QUANTILE)) * SLACK + 0.05 if len(far) else 0.05)
        return pa.table({"lang": pa.array([lang] * len(limits), pa.string()), "j": pa.array(range(len(limits)), pa.int32()), "center": pa.array(centers, pa.binary()), "top": pa.array(limits, pa.float64())})

    rows = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(counted, "doc_id long, lang string, counts binary").filter("counts is not null")
    fitted = sorted(rows.groupBy("lang").applyInArrow(one, "lang string, j int, center binary, top double").collect(), key=lambda r: (r[0], r[1]))
    if not fitted:
        return None
    centers = np.stack([np.frombuffer(r.center, np.float32) for r in fitted])
    return {"idf": idf.astype(np.float32), "langs": [r.lang for r in fitted], "centers": centers, "limits": np.array([r.top for r in fitted])}


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred (nearest language), score, rejected, lang (``und`` where rejected) per row."""
    tune(docs.sparkSession)

    def one(text):
        c = counts(text) if model else None
        if c is None:
            return UNKNOWN, 0.0, True, UNKNOWN
        cos = model["centers"] @ vector(c, model["idf"])
        j = int(np.argmax(cos))
        lang, score = model["langs"][j], min(1.0, max(0.0, float(cos[j])))
        far = 1 - score > model["limits"][j]
        return lang, score, far, UNKNOWN if far else lang

    def run(batches):
        for b in batches:
            got = list(zip(*map(one, b.column(1).to_pylist()))) or [[]] * 4
            yield pa.record_batch([b.column(0), pa.array(got[0], pa.string()), pa.array(got[1], pa.float64()), pa.array(got[2], pa.bool_()), pa.array(got[3], pa.string())], names=["doc_id", "lang_pred", "score", "rejected", "lang"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, lang string")
