"""SimHash near-dedup with vantage-point trees over Hamming distance.

1. Every document gets a 64-bit fingerprint: shingles of four lower-cased words
   (A-Z only), repeats included, vote with their XXH64 bits; a bit is set if more
   than half of the shingles have it.
2. Equal fingerprints are merged before any search, so a group of exact copies is
   one point however many documents it holds.
3. Two fingerprints within ``radius`` = 4 bits agree to within one bit on at least
   one of three blocks of bits (4 = 1 + 1 + 1 + 1 over three blocks leaves one with
   at most one).  Distance restricted to a block is a metric, so each block has a
   vantage-point tree of its own, searched with radius 1.  The top of each tree,
   fitted to a bounded sample of fingerprints, cuts the points into shards; a point
   lives in one shard and visits every shard whose boundary its ball overlaps.
4. In a shard, a multiway vantage-point tree prunes by the triangle inequality;
   what reaches a leaf together is compared exactly on all 64 bits.  A shard emits
   a spanning star of each class it finds, never all pairs.
5. The stars are joined by alternating large-star and small-star steps, each
   written to the shared folder.

The sample only chooses vantage points, which steer the layout: results are exact.
Null and empty texts, and texts without a word, have fingerprint zero and link
like any other; fewer than four words give one shingle of all of them.  Equal rows
get equal results.  component_id is the smallest non-null doc_id reachable; it is
null if a class has only null ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import materialize, partitions, row_key, tune

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Bit blocks (shift, width); on one of them two linked fingerprints differ in at most one bit.
BLOCKS = ((0, 22), (22, 21), (43, 21))
BLOCK_RADIUS = RADIUS // len(BLOCKS)
#: Fingerprints that the tops of the trees are fitted to, at least and per shard; points of a shard; depth limit of a top
#: (2**depth shards a block: at 16 some billion different fingerprints).
SAMPLE, SHARD_SAMPLE = 4096, 8
SHARD_POINTS = 16_384
MAX_DEPTH = 16
#: A fingerprint of more rows is joined by broadcast, apart from the others, unless there are more such fingerprints.
HOT_ROWS, HOT_PRINTS = 100_000, 1_000_000
LEAF = 48


def fingerprint(text: str | None) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - SHINGLE + 1].tolist()
    ends = (ends - 1)[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65_536):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65_536], ends[at : at + 65_536])], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, k (the row key), fp (the fingerprint as a signed long) per row."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["doc_id", "k", "fp"])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("k"), "text").mapInArrow(run, "doc_id long, k long, fp long")


def _part(x: np.ndarray, block: tuple[int, int]) -> np.ndarray:
    return (x >> np.uint64(block[0])) & np.uint64((1 << block[1]) - 1)


def top_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """A complete binary tree as a heap: (vantage point, median distance) per inner node, from block values."""
    nodes: list[tuple[int, int]] = []
    level = [sample]
    for _ in range(depth):
        below = []
        for own in level:
            v = int(own[0]) if len(own) else 0
            d = np.bitwise_count(own ^ np.uint64(v))
            # the far point of the first splits more evenly than a member of a clump
            if len(own) > 1:
                v = int(own[int(np.argmax(d))])
                d = np.bitwise_count(own ^ np.uint64(v))
            mid = int(np.median(d)) if len(own) else 0
            nodes.append((v, mid))
            below += [own[d <= mid], own[d > mid]]
        level = below
    return nodes


def route(values: np.ndarray, nodes: list[tuple[int, int]], depth: int, radius: int):
    """(index, shard, home) of every shard whose region the ball of ``radius`` around a value overlaps."""
    idx, node, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
    if depth == 0:
        return idx, node, home
    v = np.array([n[0] for n in nodes], np.uint64)
    mid = np.array([n[1] for n in nodes], np.int64)
    for _ in range(depth):
        d = np.bitwise_count(values[idx] ^ v[node]).astype(np.int64)
        inner, outer = d - radius <= mid[node], d + radius > mid[node]
        at_home = d <= mid[node]
        idx, node, home = (np.concatenate(x) for x in ((idx[inner], idx[outer]), (2 * node[inner] + 1, 2 * node[outer] + 2), ((home & at_home)[inner], (home & ~at_home)[outer])))
    return idx, node - (2**depth - 1), home


class Classes:
    """Union-find on 0..n-1 with whole arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        while True:
            p = self.parent[i]
            up = self.parent[p]
            if (p == up).all():
                return p
            self.parent[i] = up
            i = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _compare(points: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, classes: Classes) -> None:
    """Link every point of ``a`` with every point of ``b`` within the radius, a bounded block at a time."""
    step = max(1, 2_000_000 // max(1, len(b)))
    for at in range(0, len(a), step):
        own = a[at : at + step]
        near = np.bitwise_count(points[own][:, None] ^ points[b][None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = own[i], b[j]
        keep = i != j
        classes.link(i[keep], j[keep])


def search(points: np.ndarray, block_values: np.ndarray, homes: np.ndarray, block_radius: int, radius: int) -> Classes:
    """Vantage-point tree over ``homes``, queried with all points; links within ``radius`` on all bits."""
    classes = Classes(len(points))
    stack = [(homes, np.arange(len(points)), 0)]
    while stack:
        own, ask, fruitless = stack.pop()
        if not len(own) or not len(ask):
            continue
        if len(own) <= LEAF or len(ask) <= 4 or fruitless > 3:
            _compare(points, ask, own, radius, classes)
            continue
        v = block_values[own[(fruitless * 7919 + len(own) // 2) % len(own)]]
        d_own, d_ask = np.bitwise_count(block_values[own] ^ v), np.bitwise_count(block_values[ask] ^ v)
        for value in np.unique(d_own):
            below = own[d_own == value]
            near = ask[np.abs(d_ask.astype(np.int16) - int(value)) <= block_radius]
            stack.append((below, near, fruitless + 1 if len(below) == len(own) else 0))
    return classes


def links(points: DataFrame) -> DataFrame:
    """(a, b): for each class found in a shard, a link from every member to the smallest; b < a.  ``points`` has distinct fp."""
    n = points.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n / SHARD_POINTS))))))
    size = max(SAMPLE, SHARD_SAMPLE << depth)
    share = min(1.0, 2 * size / max(1, n))  # twice the sample by a hash, then the first of them by another
    some = points.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = [r[0] for r in some.orderBy(F.xxhash64("fp", F.lit(1)), "fp").limit(size).collect()]
    sample_bits = np.array(sample, dtype=np.int64).view(np.uint64)
    tops = [top_tree(_part(sample_bits, b), depth) for b in BLOCKS]

    def deal(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for k, block in enumerate(BLOCKS):
                i, shard, home = route(_part(fp, block), tops[k], depth, BLOCK_RADIUS)
                yield pa.record_batch([pa.array(shard * len(BLOCKS) + k), pa.array(fp[i].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def within(key, table):
        fp = np.asarray(table.column("fp").combine_chunks()).view(np.uint64)
        home = np.asarray(table.column("home").combine_chunks().to_numpy(zero_copy_only=False))
        order = np.argsort(fp.view(np.int64), kind="stable")  # the smallest of a class becomes its root
        fp, home = fp[order], home[order]
        block = BLOCKS[key[0].as_py() % len(BLOCKS)]
        classes = search(fp, _part(fp, block), np.flatnonzero(home), BLOCK_RADIUS, RADIUS)
        root = classes.find(np.arange(len(fp)))
        linked = root != np.arange(len(fp))
        return pa.table({"a": fp[linked].view(np.int64), "b": fp[root[linked]].view(np.int64)})

    dealt = points.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(within, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the class; for the ends of ``edges`` (a, b) only.

    Alternates large-star (neighbours above a node move to its smallest neighbour) and small-star (those below do)
    until neither changes an edge.  Every step is a partial aggregate and a join, written to the shared folder.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "stars")
    seen = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = materialize(small.filter("a > b").distinct(), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def grouped_rows(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, k, fp, component_id, root (names the component, also where no row of it has an id)."""
    prints = materialize(fingerprints(docs), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    points = materialize(points, "points")
    roots = materialize(components(links(points)), "roots")
    placed = points.join(roots, points.fp == roots.node, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    merged = placed.join(roots.select(F.col("root").alias("merged")).distinct(), placed.root == F.col("merged"), "left")
    single = merged.filter("merged is null").select("fp", F.col("least").alias("component_id"), "root", "rows")
    own = merged.filter("merged is not null").select("fp", "least", "root", "rows")
    smallest = own.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = materialize(single.union(own.join(smallest, "root").select("fp", "component_id", "root", "rows")), "placed")
    # Rows of one fingerprint (all empty texts share one) never meet in one task.
    hot = placed.filter(F.col("rows") > HOT_ROWS).drop("rows")
    columns = ["doc_id", "k", "fp", "component_id", "root"]
    if not 0 < hot.count() <= HOT_PRINTS:
        return prints.join(placed, "fp").select(*columns)
    rest = prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(placed.filter(F.col("rows") <= HOT_ROWS), "fp")
    return prints.join(F.broadcast(hot), "fp").select(*columns).union(rest.select(*columns))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, fingerprint (16 hex digits), component_id."""
    return grouped_rows(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, k): of each component the row that comes first by id (null ids last) and row key."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k")
    first = grouped_rows(docs).groupBy("root").agg(F.min_by(F.struct("doc_id", "k"), order).alias("first"))
    return first.select("first.doc_id", "first.k")
