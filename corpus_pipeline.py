"""The corpus pipeline: five stages of the training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and
returns the columns of documents (the last one adds ``copy``).

Defined results, for all stages: an empty table stays empty; null texts are kept as
documents without words, until a stage takes them for copies of one another; rows that
share an id but not a text are different documents; rows equal in id and text are one
until the second stage, which keeps one of them; null ids, languages, sources and
sizes are kept as they are; further columns of the input, whatever they are called,
are dropped.  Reruns give equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, mixing, simhash, substring, toxicity
from lexloom.llm.common import materialize, release, row_key, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go; every third label stays out of its training, as in op8.

    Texts without a word score 0 and stay; without a label of either kind everything stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = toxicity.fit(docs, labels)
    return toxicity.score_documents(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays (null ids come last, then the row key decides); rows equal in id and text count once.

    Null and empty texts and texts without a word are copies of one another.
    """
    first = simhash.first_rows(docs).select(F.col("doc_id").alias("f_id"), F.col("k").alias("f_key"))
    own = docs.select(*COLUMNS).withColumn("k", row_key())
    kept = own.join(first, (F.col("k") == F.col("f_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("f_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "k"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go, in all their copies; so does a document of which nothing is left.

    A text that loses words is its other words joined by one space, with n_chars counted anew; other rows stay as they are.
    """
    cut = substring.substring_dedup(docs, carry=("lang", "source", "n_chars"))
    out = cut.filter("n_removed = 0 or n_removed < n_words")
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; null texts and texts without a word overlap none."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks; sources without a word are not taken; a null source is one of its own."""
    return mixing.mix_documents(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first two stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it; what it read is deleted then."""
    mark = written()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
            release(spark, mark, keep=1)
    return docs
