"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import chat, decontaminate, language, licenses, mixing, quality, simhash, substring, suffixes, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality.line_verdicts(table(spark, sf_dir, "documents"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit(docs.filter(~held_out))
    got = language.identify(docs, model)
    return got.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.windows(rows.union(extra)))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.get("items", F.lit(0)).alias("first_item"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    got = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    return got.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_language_id,
        op3_chat_windows,
        op4_substring_dedup,
        op5_benchmark_decontamination,
        op6_license_scan,
        op7_source_mixing,
        op8_toxicity,
        op9_simhash_near_dedup,
        op10_suffix_array_dedup,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'"

SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, source, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, source, string_split(t, chr(10)) AS l FROM d)),
worded AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded WHERE n > 0 GROUP BY doc_id),
norm AS (SELECT doc_id, source, n, array_to_string(regexp_extract_all(translate(line, {_AZ}), '[^\x20\x09-\x0D]+'), ' ') AS h FROM worded WHERE n >= 1),
hosts AS (SELECT source, count(DISTINCT doc_id) AS size FROM d GROUP BY source),
often AS (SELECT norm.source, h FROM norm JOIN hosts ON norm.source IS NOT DISTINCT FROM hosts.source GROUP BY norm.source, h HAVING count(DISTINCT doc_id) > 4 AND count(DISTINCT doc_id) > any_value(size) * 0.05::DOUBLE),
gone AS (SELECT doc_id, sum(n) AS n FROM norm JOIN often ON norm.h = often.h AND norm.source IS NOT DISTINCT FROM often.source GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, base_failed IS FALSE AND NOT n_words - n_removed_words < 0.3::DOUBLE * n_words AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)""",
    "op4_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(list_slice(w, i, i + 34), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
cov AS (SELECT doc_id, i, word, max(CASE WHEN twice.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM pos LEFT JOIN twice USING (doc_id, i)),
kept AS (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS t FROM cov GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    # Without seeds: every diagonal of every document and item on which a word is equal.
    "op5_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
n AS (SELECT *, row_number() OVER (ORDER BY item_id, w) AS bid, least(13, len(w)) AS width FROM b WHERE len(w) > 0),
dp AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM d),
bp AS (SELECT bid, unnest(w) AS t, unnest(range(len(w))) AS j FROM n),
e AS (SELECT doc_id, bid, count(*) OVER (PARTITION BY doc_id, bid, i - j ORDER BY j RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS e FROM dp JOIN bp USING (t)),
ok AS (SELECT doc_id, count(DISTINCT item_id) AS n, min(item_id) AS first_item FROM e JOIN n USING (bid) WHERE e / CAST(width AS DOUBLE) >= 0.8::DOUBLE GROUP BY doc_id)
SELECT doc_id, ok.n IS NOT NULL AS contaminated, coalesce(ok.n, 0) AS n_items, ok.first_item FROM d LEFT JOIN ok USING (doc_id)""",
    "op7_source_mixing": rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, coalesce(CAST(doc_id AS VARCHAR), 'null:' || coalesce(text, '')) AS name FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
v AS (SELECT *, source_size * 2.0::DOUBLE AS top, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM s),
l AS (SELECT *, top / w AS level FROM v),
r AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(top) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach FROM l),
h AS (SELECT reach AS height FROM r WHERE reach <= level ORDER BY level, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN height IS NULL THEN top ELSE least(top, height * w) END AS target FROM r LEFT JOIN h ON true),
m AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  CAST(CAST('0x' || substr(md5('mix-1:' || name), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM m""",
    "op10_suffix_array_dedup": r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
win AS (SELECT doc_id, i, hash(substr(x, 2 * i - 1, 200)) AS g FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 98)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gaps AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM late),
runs AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM gaps),
spans AS (SELECT doc_id, r, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, r),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS since FROM spans),
kept AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS last, string_agg(substr(x, 2 * since - 1, 2 * (a - since)), '' ORDER BY a) AS t FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN t IS NULL AND n IS NULL THEN x ELSE coalesce(t, '') || substr(x, 2 * last - 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}
