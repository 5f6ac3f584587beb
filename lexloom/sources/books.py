"""Plain-text sources: clipping between markers, paragraphs, headings, sentences, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clip(text: Column, start: str, end: str) -> Column:
    """Text strictly between the first line that begins with ``start`` and the next that begins with ``end``; null without both."""
    clean = F.replace(F.regexp_replace(text, "^﻿", ""), F.lit("\r\n"), F.lit("\n"))
    found = F.regexp_extract(clean, rf"(?sm)^{start}[^\n]*\n(.*?)^{end}", 1)
    return F.when(clean.rlike(rf"(?sm)^{start}[^\n]*\n(.*?)^{end}"), found)


def book_text(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """(path, text) of whole files, clipped; a file without its markers is an error."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    body = clip(F.col("value"), start, end)
    return files.select("path", F.when(body.isNull(), F.raise_error(F.concat(F.lit("markers missing: "), "path"))).otherwise(body).alias("text"))


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line", "text"))


def paragraphs(rows: DataFrame) -> DataFrame:
    """(id, par, line, text): blank-line blocks of (id, line, text), lines joined by a space, or directly after a hyphen."""
    by = Window.partitionBy("id").orderBy("line")
    blank = F.trim("text") == ""
    own = rows.withColumn("par", F.sum(F.when(blank, 1).otherwise(0)).over(by)).filter(~blank)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: F.trim(x["text"])), " ")
    return own.groupBy("id", "par").agg(F.min("line").alias("line"), F.regexp_replace(body, "- ", "-").alias("text"))


def fill_headings(rows: DataFrame, heading: Column) -> DataFrame:
    """Adds ``section``: the last text that was a heading, at or before each line."""
    by = Window.partitionBy("id").orderBy("line")
    return rows.withColumn("section", F.last(F.when(heading, F.col("text")), ignorenulls=True).over(by))


def sentences(text: Column) -> Column:
    """Array of sentences: cut after . ! ? (and closing quotes) unless a lower-case letter follows, and at blank lines."""
    marked = F.regexp_replace(text, r"([.!?][\"'’”)\]]*)\s+(?!\p{Ll})", "$1\u0001")
    marked = F.regexp_replace(marked, r"\n[ \t]*\n", "\u0001")
    parts = F.transform(F.split(marked, "\u0001"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(parts, lambda s: s != "")


def forbidden(df: DataFrame, columns: list[str], word: str) -> DataFrame:
    """Rows of ``df`` that hold the word in one of the columns, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(word.lower()), F.lit(False))
    return df.filter(hit)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
