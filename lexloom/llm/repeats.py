"""Candidate search for repeated token windows, shared by the two substring operators.

A window of ``n`` tokens can repeat only if its *anchor* does: the smallest-hashed
gram of ``k`` tokens in it (the leftmost of equals).  The choice depends on the
window alone, so every copy of a window chooses its anchor at the same place, and
about one gram in (n - k) / 2 is an anchor.  Each occurrence of an anchor owns a run
of window starts; the tokens under them are its *slice*.  Anchors only say which
slices are to be compared; which windows go is decided by the operator's own method
(``judge``), on the slices' texts, wherever slices meet:

1. ``_Sender``: map over documents.  Slices that a task holds several times go to
   ``judge`` on the spot (as a combiner), and one of each goes on.  What travels is a
   packed record without text, by anchor.
2. ``settle``: per bucket of anchors.  Anchors of one record are done; all records of
   the others ask for their text.
3. ``hand_out``: documents, dealt in blocks, cut the asked slices.
4. ``decide``: ``judge`` compares the slices of a bucket.
5. ``finish``: blocks of documents and the removed windows give the result.

Two things keep buckets small.  Of an anchor with more than ``CHUNK`` records the
slices with equal hashes are dealt in chunks to different buckets, each with the
earliest of them; only slices with different hashes meet in one.  And an anchor held
by a large share of all documents in ever different surroundings (a common short
line) is found in a sample of documents, which only steers the layout: its windows
travel one by one, keyed by their own tokens, and so spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import BATCH_ROWS, materialize, pack, row_key, split_by, tune, unpack, unpack_all

#: Window starts handled at once in a long text.
BLOCK = 1 << 18
#: Anchors gathered before records are packed and sent.
FLUSH = 200_000
#: Text in one block of documents, buckets of slices per block (slices overlap, about four times), most blocks and most tasks.
PART_BYTES, SPREAD, MOST_PARTS, MOST_TASKS = 32 << 20, 4, 1 << 20, 1 << 16
#: Text that the method compares at once; groups are never split for it.
PIECE = 4 << 20
#: Records of an anchor above which equal slices are dealt in chunks of this size.
CHUNK = 4096
#: An anchor is hot in this share of all documents, or in so many; documents sampled at least, finds at least, anchors at most
#: (beyond the million hottest an anchor stands in about one document of ten thousand at most).
HOT_SHARE, HOT_DOCS, HOT_SAMPLE, HOT_LEAST, HOT_MOST = 0.01, 50_000, 2_000, 24, 1_000_000
NULL_ID = -(2**63)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)
ROW = "kind int, block int, bucket int, data binary"
_ROWS = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
#: Packed rows in one Arrow batch.
BATCH_BYTES = 1 << 20


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + b
    x ^= x >> _S
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def grams(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k tokens from each position on, by doubling."""
    h, length = tokens, 1
    while 2 * length <= k:
        h, length = mix(h[: len(h) - length], h[length:]), 2 * length
    if length < k:
        h = mix(h[: len(h) - (k - length)], h[k - length :])
    return h


def anchors(tokens: np.ndarray, n: int, k: int):
    """(place, gram hash, first start, last start) of every anchor of a token array."""
    w = n - k + 1
    if len(tokens) < n:
        return
    for at in range(0, len(tokens) - n + 1, BLOCK):
        part = tokens[at : at + BLOCK + n - 1]
        g = grams(part, k)
        low = (g & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(g), dtype=np.uint64)
        length = 1
        while 2 * length <= w:
            low, length = np.minimum(low[: len(low) - length], low[length:]), 2 * length
        if length < w:
            low = np.minimum(low[: len(low) - (w - length)], low[w - length :])
        place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(place)])) - 1
        yield place[first] + at, g[place[first]], first + at, last + at


@dataclass(frozen=True)
class Spec:
    """The tokens of an operator and its method.

    ``tokens``: text to token hashes; ``cutter``: text to a function (from token, to token) -> bytes of a slice.

    ``judge(r, texts, n, combine)`` compares slices.  ``r`` has one row per slice, sorted by ``g`` (slices of one group
    are compared) and owner (``did``, ``key``, ``lo``), with ``weight`` (copies it stands for; 0 if a row is another
    time the same place) and ``len`` (its windows less one); ``texts`` are the slices' bytes.  It returns the removed
    windows as (row, first, last window of a run) and, per row, a number that equal slices share.  With ``combine`` only
    slices equal in whole need to be found.
    """

    n: int
    k: int
    tokens: Callable
    cutter: Callable
    judge: Callable


def _digest(x: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(x.tobytes())


def hot_anchors(docs: DataFrame, spec: Spec, total: int) -> np.ndarray:
    """Anchors that a sample finds in HOT_SHARE of the ``total`` documents, or in HOT_DOCS of them, sorted.

    The second bound keeps buckets small however many documents there are; the sample grows as its share falls.
    """
    n, k, tokens = spec.n, spec.k, spec.tokens
    least = min(HOT_SHARE, HOT_DOCS / max(1, total))
    size = max(HOT_SAMPLE, HOT_LEAST / least if least else HOT_SAMPLE)

    def run(batches):
        for b in batches:
            for text in b.column(0).to_pylist():
                found = [g for _, g, _, _ in anchors(tokens(text), n, k)]
                if found:
                    yield pa.record_batch([pa.array(np.unique(np.concatenate(found)).view(np.int64))], names=["g"])

    share = min(1.0, size / max(1, total))
    sample = docs.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    counts = sample.mapInArrow(run, "g long").groupBy("g").count().filter(F.col("count") >= max(HOT_LEAST, int(least * size)))
    found = [r[0] for r in counts.orderBy(F.desc("count"), "g").limit(HOT_MOST).collect()]
    return np.sort(np.array(found, dtype=np.int64)).view(np.uint64)


def judged(r: dict, texts: list[bytes], spec: Spec, combine: bool):
    """``spec.judge`` on whole groups of about PIECE bytes at a time, which bounds its memory; rows are sorted by ``g``."""
    heads = _runs(r["g"])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))[np.append(heads[1:], len(texts)) - 1]
    cuts = np.append(0, np.append(heads[1:], len(texts))[np.flatnonzero(np.diff(ends // PIECE, append=-1))])
    found, labels = [], []
    for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
        (which, a, b), label = spec.judge({c: x[lo:hi] for c, x in r.items()}, texts[lo:hi], spec.n, combine)
        found.append((which + lo, a, b))
        if combine:
            labels.append(label + (labels[-1].max() + 1 if labels else 0))
    return tuple(np.concatenate(x) for x in zip(*found)), np.concatenate(labels) if combine else None


class _Sender:
    """Gathers the records of one task and packs them by bucket and block."""

    def __init__(self, spec: Spec, buckets: int, hot: np.ndarray):
        self.spec, self.buckets, self.hot = spec, buckets, hot
        self.clear()

    def clear(self):
        self.rows, self.slices, self.texts, self.n = [], [], [], 0

    def add(self, did: int, key: int, block: int, text: str | None) -> None:
        n = self.spec.n
        tok = self.spec.tokens(text)
        for _, g, lo, hi in anchors(tok, n, self.spec.k):
            if len(self.hot) and (is_hot := np.isin(g, self.hot)).any():
                lows, highs, gs = [lo[~is_hot]], [hi[~is_hot]], [g[~is_hot]]
                for a, b in zip(lo[is_hot].tolist(), hi[is_hot].tolist()):
                    s = np.arange(a, b + 1)
                    lows.append(s)
                    highs.append(s)
                    gs.append(np.array([_digest(tok[i : i + n]) for i in s.tolist()], dtype=np.uint64))
                lo, hi, g = np.concatenate(lows), np.concatenate(highs), np.concatenate(gs)
            data, size = tok.tobytes(), tok.itemsize
            d = xxhash.xxh3_64_intdigest
            self.slices += [d(data[a * size : (b + n) * size]) for a, b in zip(lo.tolist(), hi.tolist())]
            whole = np.full(len(g), len(self.texts))
            self.rows.append((np.full(len(g), did), np.full(len(g), key), np.full(len(g), block, np.int32), g, lo.astype(np.int64), hi.astype(np.int64), whole))
            self.n += len(g)
        self.texts.append(text)

    def flush(self) -> Iterator[tuple]:
        """Rows (kind, block, bucket, data): kind 0 records, kind 1 removed windows."""
        if not self.n:
            self.clear()
            return
        names = ("did", "key", "block", "g", "lo", "hi", "doc")
        r = dict(zip(names, (np.concatenate(x) for x in zip(*self.rows)))) | {"s": np.array(self.slices, dtype=np.uint64)}
        r["len"] = r.pop("hi") - r["lo"]
        order = np.lexsort((r["lo"], r["key"], r["did"], r["s"], r["g"]))
        r = {c: a[order] for c, a in r.items()}
        once = _runs(r["g"], r["s"], r["did"], r["key"], r["lo"])  # rows that repeat a document count once
        r = {c: a[once] for c, a in r.items()}
        r["many"] = np.zeros(len(r["g"]), np.int8)
        first = _runs(r["g"], r["s"])
        size = np.diff(np.concatenate((first, [len(r["g"])])))
        twice = np.repeat(size > 1, size)
        if twice.any():
            same = {c: a[twice] for c, a in r.items()}
            order = np.lexsort((same["lo"], same["key"], same["did"], same["g"]))
            same = {c: a[order] for c, a in same.items()}
            texts, cut, last = [b""] * len(order), None, None
            for i in np.argsort(same["doc"], kind="stable").tolist():
                if (doc := same["doc"][i]) != last:
                    cut, last = self.spec.cutter(self.texts[doc]), doc
                texts[i] = cut(int(same["lo"][i]), int(same["lo"][i]) + int(same["len"][i]) + self.spec.n)
            same["weight"] = np.ones(len(order))
            (which, a, b), label = judged(same, texts, self.spec, True)
            yield from removed(same["did"][which], same["key"][which], same["block"][which], same["lo"][which] + a, same["lo"][which] + b, self.buckets)
            _, head, of = np.unique(label, return_index=True, return_inverse=True)  # the first row of a label is the earliest
            same["many"] = (np.bincount(of)[of] > 1).astype(np.int8)
            del same["weight"]
            r = {c: np.concatenate((a[~twice], same[c][head])) for c, a in r.items()}
        for b, i in split_by((r["g"] % np.uint64(self.buckets)).astype(np.int64)):
            i = i[np.lexsort((r["lo"][i], r["did"][i]))]
            key = r["key"][i].astype(np.int64).view(np.uint64)
            yield 0, 0, b, pack(did=r["did"][i], key=key, block=r["block"][i].astype(np.int32), g=r["g"][i], s=r["s"][i], lo=r["lo"][i], len=r["len"][i].astype(np.int16), many=r["many"][i])
        self.clear()


def removed(did, key, block, lo, hi, buckets: int) -> Iterator[tuple]:
    """Rows of kind 1, packed by document block; any bucket takes them along."""
    for b, i in split_by(block):
        i = i[np.lexsort((lo[i], key[i], did[i]))]
        yield 1, b, b % buckets, pack(did=did[i], key=key[i], lo=lo[i].astype(np.int64), hi=(hi - lo)[i].astype(np.int32))


def by_value(column: str, f: Callable) -> Callable:
    """For mapInArrow: ``f(table)`` for each run of rows of one value of ``column``, one run in memory at a time.

    Spark hands a task's rows on as they come; groupBy().applyInArrow would first sort them in pages of the executor's heap.
    """

    def run(batches):
        held, value = [], None
        for b in batches:
            v = b.column(column).to_numpy()
            starts = _runs(v).tolist()
            for lo, hi in zip(starts, [*starts[1:], len(v)]):
                if held and v[lo] != value:
                    yield from f(pa.Table.from_batches(held)).to_batches()
                    held = []
                value = v[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from f(pa.Table.from_batches(held)).to_batches()

    return run


def _table(rows: list[tuple]) -> pa.Table:
    """Rows in batches of about BATCH_BYTES, which is what the executor holds of them at once beside its heap."""
    ends = np.cumsum(np.fromiter((len(r[3]) for r in rows), np.int64, len(rows)))
    cuts = [0, *(np.flatnonzero(np.diff(ends // BATCH_BYTES)) + 1).tolist(), len(rows)]
    parts = [list(zip(*rows[a:b])) for a, b in zip(cuts, cuts[1:]) if a < b]
    return pa.Table.from_batches([pa.record_batch([pa.array(c, f.type) for c, f in zip(p, _ROWS)], schema=_ROWS) for p in parts], _ROWS)


def _runs(*columns):
    """Starts of the runs of equal rows in sorted columns."""
    change = np.zeros(len(columns[0]), bool)
    if len(change):
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def settle(rows: list[tuple], spec: Spec, buckets: int) -> list[tuple]:
    """One bucket: removed windows as they are (kind 1) and asked slices (kind 2, by document block).

    ``sub`` names the group in which a slice is compared: its anchor, or a chunk of an anchor with many records.
    """
    out = [r for r in rows if r[0] == 1]
    blobs = [r[3] for r in rows if r[0] == 0]
    if not blobs:
        return out
    r = unpack_all(blobs)
    r["key"] = r["key"].view(np.int64)
    order = np.lexsort((r["lo"], r["key"], r["did"], r["s"], r["g"]))
    r = {n: a[order] for n, a in r.items()}
    once = _runs(r["g"], r["s"], r["did"], r["key"], r["lo"])  # rows that repeat a document count once
    many = np.maximum.reduceat(r["many"], once)
    r = {n: a[once] for n, a in r.items()} | {"many": many}
    by_gram = _runs(r["g"])
    width = np.diff(np.concatenate((by_gram, [len(r["g"])])))
    asks, crowd = np.repeat(width > 1, width), np.repeat(width > CHUNK, width)
    by_slice = _runs(r["g"], r["s"])
    size = np.diff(np.concatenate((by_slice, [len(r["g"])])))
    place = np.arange(len(r["g"])) - np.repeat(by_slice, size)  # among the equal ones, the earliest first
    chunk = np.where(crowd & (place > 0), 1 + (place - 1) // CHUNK, 0).astype(np.uint64)
    r["sub"] = np.where(chunk > 0, mix(r["g"] ^ r["s"], chunk), r["g"])
    take = [np.flatnonzero(asks)]
    subs = [r["sub"][asks]]
    opens = np.flatnonzero((chunk > 0) & ((place - 1) % CHUNK == 0))
    take.append(np.repeat(by_slice, size)[opens])  # the earliest goes along with each chunk
    subs.append(r["sub"][opens])
    take, sub = np.concatenate(take), np.concatenate(subs)
    for b, i in split_by(r["block"][take]):
        t = take[i]
        out.append((2, b, 0, pack(did=r["did"][t], key=r["key"][t], g=r["g"][t], sub=sub[i], lo=r["lo"][t], len=r["len"][t].astype(np.int32), many=r["many"][t])))
    return out


def _documents(table: pa.Table):
    """The rows of a block of documents by (did, key)."""
    found: dict[tuple[int, int], list[int]] = {}
    for i, d in enumerate(zip(table.column("did").to_pylist(), table.column("k").to_pylist())):
        found.setdefault(d, []).append(i)
    return found


def hand_out(docs: pa.Table, asks: pa.Table, spec: Spec, buckets: int) -> list[tuple]:
    """The asked slices of one block of documents, packed by bucket of ``sub`` (kind 3)."""
    if not asks.num_rows:
        return []
    r = unpack_all(asks.column("data").to_pylist())
    found, text = _documents(docs), docs.column("text")
    order = np.lexsort((r["lo"], r["key"], r["did"]))
    r = {n: a[order] for n, a in r.items()}
    cuts, starts = [b""] * len(order), _runs(r["did"], r["key"])
    for a, b in zip(starts, [*starts[1:], len(order)]):
        cut = spec.cutter(text[found[int(r["did"][a]), int(r["key"][a])][0]].as_py())
        for j in range(a, b):
            cuts[j] = cut(int(r["lo"][j]), int(r["lo"][j]) + int(r["len"][j]) + spec.n)
    block = docs.column("block")[0].as_py()
    out = []
    for b, i in split_by((r["sub"] % np.uint64(buckets)).astype(np.int64)):
        raw = np.frombuffer(b"".join(cuts[j] for j in i), np.uint8)
        meta = pack(**{n: r[n][i] for n in ("did", "key", "g", "sub", "lo", "len", "many")}, size=np.array([len(cuts[j]) for j in i], np.int32))
        out.append((3, block, b, len(meta).to_bytes(8, "little") + meta + pack(raw=raw)))
    return out


def decide(rows: list[tuple], spec: Spec, buckets: int) -> list[tuple]:
    """One bucket of slices: ``judge`` says which windows go."""
    if not rows:
        return []
    parts, texts, where = [], [], []
    for _, block, _, data in rows:
        n = int.from_bytes(data[:8], "little")
        parts.append(unpack(data[8 : 8 + n]))
        raw = unpack(data[8 + n :])["raw"].tobytes()
        ends = np.cumsum(parts[-1]["size"].astype(np.int64)).tolist()
        texts += [raw[a:b] for a, b in zip([0, *ends], ends)]
        where.append(np.full(len(parts[-1]["g"]), block, np.int32))
    r = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]} | {"block": np.concatenate(where)}
    order = np.lexsort((r["lo"], r["key"], r["did"], r["sub"]))
    r = {n: a[order] for n, a in r.items()}
    texts = [texts[i] for i in order]
    r["weight"] = 1.0 + r["many"]
    again = np.lexsort((r["lo"], r["key"], r["did"], r["g"]))  # one place may be in several chunks
    first = np.zeros(len(again), bool)
    first[again[_runs(*(r[c][again] for c in ("g", "did", "key", "lo")))]] = True
    r["weight"][~first] = 0
    r["g"] = r["sub"]
    (which, a, b), _ = judged(r, texts, spec, False)
    return list(removed(r["did"][which], r["key"][which], r["block"][which], r["lo"][which] + a, r["lo"][which] + b, buckets))


def covered(did: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int):
    """From removed windows: per document (did, key) its merged token spans."""
    order = np.lexsort((lo, key, did))
    did, key, lo, hi = did[order], key[order], lo[order], hi[order]
    starts = _runs(did, key)
    for a, b in zip(starts, [*starts[1:], len(did)]):
        end = np.maximum.accumulate(hi[a:b] + n)
        new = np.flatnonzero(np.concatenate(([True], lo[a + 1 : b] > end[:-1])))
        yield (int(did[a]), int(key[a])), lo[a:b][new], end[np.concatenate((new[1:] - 1, [b - a - 1]))]


def repeated_windows(docs: DataFrame, spec: Spec, finish: Callable, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``finish(text, starts, ends)`` per document row, with the merged spans of removed tokens.

    Its values follow doc_id; the columns named in ``carry`` come last, as they are; one that has the name of a result
    comes out as ``<name>_input``.
    """
    spark = docs.sparkSession
    tune(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))  # texts that a scan decodes at once
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    own = own.withColumns({"did": F.coalesce("doc_id", F.lit(NULL_ID)), "k": row_key()})
    total, size = own.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = min(MOST_PARTS, max(4 * spark.sparkContext.defaultParallelism, -(-(size or 0) // PART_BYTES)))
    buckets = SPREAD * parts
    own = own.withColumn("block", F.pmod("k", F.lit(parts)).cast("int"))
    hot = spark.sparkContext.broadcast(hot_anchors(own, spec, total))

    def send(batches):
        sender = _Sender(spec, buckets, hot.value)
        for b in batches:
            for did, key, text, block in zip(*(b.column(i).to_pylist() for i in range(4))):
                sender.add(did, key, block, text)
                if sender.n >= FLUSH:
                    yield from _table(list(sender.flush())).to_batches()
        yield from _table(list(sender.flush())).to_batches()

    def rows_of(table):
        return list(zip(*(table.column(n).to_pylist() for n in ("kind", "block", "bucket", "data")))) if table.num_rows else []

    def settled(table):
        return _table(settle(rows_of(table), spec, buckets))

    def handed(docs_table, asks):
        return _table(hand_out(docs_table, asks, spec, buckets) if docs_table.num_rows else [])

    def decided(table):
        return _table(decide(rows_of(table), spec, buckets))

    results = ["doc_id", *(n.split()[0] for n in schema.split(", "))]
    out_schema = pa.schema([("doc_id", pa.int64()), *((n.split()[0], pa.int64() if n.split()[1] == "long" else pa.string()) for n in schema.split(", "))])
    carried = [f"{c}_input" if c in results else c for c in carry]
    kept_types = "".join(f", `{c}` {own.schema[f'carry_{i}'].dataType.simpleString()}" for i, c in enumerate(carried))

    def finished(docs_table, spans):
        if not docs_table.num_rows:
            return pa.table({})
        found: dict[tuple[int, int], tuple] = {}
        if spans.num_rows:
            r = unpack_all(spans.column("data").to_pylist())
            found = {d: (a, b) for d, a, b in covered(r["did"], r["key"], r["lo"], r["lo"] + r["hi"], spec.n)}
        none = np.zeros(0, np.int64)
        ids, text = docs_table.column("doc_id").to_pylist(), docs_table.column("text")
        got: list = []
        for i, d in enumerate(zip(docs_table.column("did").to_pylist(), docs_table.column("k").to_pylist())):
            got.append((ids[i], *finish(text[i].as_py(), *found.get(d, (none, none)))))
        out = pa.table([pa.array(c, f.type) for c, f in zip(zip(*got), out_schema)], schema=out_schema)
        for i, c in enumerate(carried):
            out = out.append_column(c, docs_table.column(f"carry_{i}"))
        return out

    # As many tasks as blocks and buckets, so that a task's share stays the same at any size.
    tasks = {"block": min(parts, MOST_TASKS), "bucket": min(buckets, MOST_TASKS)}
    dealt = lambda df, by: df.repartitionById(tasks[by], F.col(by))

    def each_bucket(df, f):
        own_task = dealt(df, "bucket")
        if buckets > tasks["bucket"]:
            own_task = own_task.sortWithinPartitions("bucket")
        return own_task.mapInArrow(by_value("bucket", f), ROW)

    def with_documents(df):
        return dealt(own, "block").groupBy("block").cogroup(dealt(df, "block").groupBy("block"))

    sent = own.select("did", "k", "text", "block").mapInArrow(send, ROW)
    first = materialize(each_bucket(sent, settled).coalesce(tasks["block"]), "settled")  # as many files as blocks
    slices = with_documents(first.filter("kind = 2")).applyInArrow(handed, ROW)
    gone = first.filter("kind = 1").union(each_bucket(slices, decided))
    return with_documents(gone).applyInArrow(finished, f"doc_id long, {schema}{kept_types}")
