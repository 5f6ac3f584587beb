"""Quality rules: lines that too many documents of a host share are removed; depleted documents are rejected.

One pass over the texts gives, per row, the base figures and the hashes and word
counts of its normalised lines (A-Z lower-cased, digits to 0, runs of blanks to one
space).  The lines, not the texts, are shuffled: distinct documents are counted per
(host, line), first by (host, line, document), so a line that a third of all rows
holds is counted in parts.  A line goes if it is held by more than ``max_share`` of
its host's documents, and by more than ``least_docs``; so the rule is the same for
hosts of any size.  The lines to go are few per host (lines per document divided by
``max_share`` at most); they are broadcast after a check of their number, else joined
with salts.  A document is depleted if less than ``min_left`` of its words remains.
Every line with a word counts; a caller may exempt those below ``min_line_words`` words.

Defined results: null and empty texts have no words and fail the base rule; a null
source is a host of its own; equal rows are one document and get equal results;
documents are counted by doc_id, null ids by a hash of the text; further columns of
the input may have any name.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import boxed, materialize, row_key, tune, unboxed

MAX_SHARE, LEAST_DOCS = 0.05, 4
MIN_LEFT = 0.3
MIN_LINE_WORDS = 1
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Lines to go that may be broadcast (about 60 bytes each); salts of a line beyond that.
BROADCAST_LINES, SALTS = 500_000, 32

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
_SYMBOLS = re.compile(rb"[#*$%&|<>]")


def line_hash(line: bytes) -> tuple[int, int]:
    """(signed 64-bit hash of the normalised line, its words)."""
    words = line.translate(_LOWER).split()
    h = xxhash.xxh3_64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >> 63 else h, len(words)


def base_figures(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(_SYMBOLS.findall(raw))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.split(None, 1):
            seen.add(line)
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeat = 0
    if len(set(grams)) < len(grams):
        first: dict[tuple, int] = {}
        hit = bytearray(len(words))
        for i, g in enumerate(grams):
            j = first.setdefault(g, i)
            if j != i:
                hit[j : j + 5] = hit[i : i + 5] = b"\1" * 5
        repeat = sum(hit)
    return len(words), chars, symbols, dup, repeat


def figures(docs: DataFrame, min_line_words: int) -> DataFrame:
    tune(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("k"), F.col("source").cast("string").alias("host"), "text")
    schema = "doc_id long, k long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<pos:int,h:long,n:int>>"
    line_type = pa.list_(pa.struct([("pos", pa.int32()), ("h", pa.int64()), ("n", pa.int32())]))

    def run(batches):
        for b in batches:
            stats, lines = [], []
            for text in b.column(3).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                stats.append(base_figures(raw, raw.split()))
                own = ((i, *line_hash(line)) for i, line in enumerate(raw.split(b"\n")))
                lines.append([{"pos": i, "h": h, "n": n} for i, h, n in own if n >= min_line_words])
            cols = [pa.array(c, pa.int64()) for c in zip(*stats)] if stats else [pa.array([], pa.int64())] * 5
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), *cols, pa.array(lines, line_type)], names=["doc_id", "k", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    return own.mapInArrow(run, schema)


def _marked(lines: DataFrame, frequent: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``lines`` whose line is frequent; no task gets all rows of one line."""
    frequent = materialize(frequent, "frequent")
    if frequent.count() <= BROADCAST_LINES:
        return lines.join(F.broadcast(frequent), by)
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("k", "pos"), F.lit(SALTS)))
    return salted.join(frequent.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*by, "salt"]).drop("salt")


def line_verdicts(docs: DataFrame, max_share: float = MAX_SHARE, least_docs: int = LEAST_DOCS, min_left: float = MIN_LEFT, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """Per row: doc_id, k, the base figures, n_removed_words, removed (line numbers from 0), base_failed, depleted, kept."""
    rows = materialize(figures(docs, min_line_words), "lines").withColumn("member", F.coalesce("doc_id", "k"))
    named = rows.withColumn("no_host", F.col("host").isNull()).withColumn("host", F.coalesce("host", F.lit("")))
    lines = named.select("k", "member", "host", "no_host", F.inline("lines"))
    by = ["host", "no_host", "h"]
    size = named.select("host", "no_host", "member").distinct().groupBy("host", "no_host").agg(F.count(F.lit(1)).alias("size"))
    held = lines.select(*by, "member").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > least_docs)
    frequent = held.join(size, ["host", "no_host"]).filter(F.col("held") > F.col("size") * F.lit(max_share)).select(*by)
    hits = _marked(lines, frequent, by).groupBy("k", "member").agg(F.collect_set(F.struct("pos", "n")).alias("gone"))
    out = rows.drop("lines").join(hits, ["k", "member"], "left")
    gone = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0).cast("long"))
    out = out.withColumn("n_removed_words", gone).withColumn("removed", F.array_sort(F.transform(F.coalesce("gone", F.array()), lambda x: x["pos"])))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed_words") < F.lit(min_left) * F.col("n_words")
    out = out.withColumn("base_failed", failed).withColumn("depleted", depleted)
    return out.select("doc_id", "k", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "removed", "base_failed", "depleted", (~failed & ~depleted).alias("kept"))


def clean_documents(docs: DataFrame, **options) -> DataFrame:
    """The kept rows of ``docs``, all columns, their texts without the removed lines; ``options`` as in ``line_verdicts``."""
    verdicts = line_verdicts(docs, **options).filter("kept").select("doc_id", "k", "removed").distinct()
    same = (F.col("own.k") == F.col("v.k")) & F.col("own.id").eqNullSafe(F.col("v.doc_id"))
    joined = boxed(docs).alias("own").join(verdicts.alias("v"), same)
    lines = F.filter(F.split("own.row.text", "\n", -1), lambda x, i: ~F.array_contains("v.removed", i))
    text = F.when(F.size("v.removed") > 0, F.array_join(lines, "\n")).otherwise(F.col("own.row.text"))
    return unboxed(joined.withColumn("row", F.col("own.row").withField("text", text)))
