"""Streaming lookups: a stream of words against the static form table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import lookup_key


def lookup_stream(words: DataFrame, forms: DataFrame) -> DataFrame:
    """(word, key): stream-static join; words without a form stand for themselves."""
    own = words.select("word", lookup_key(F.col("word")).alias("form"))
    return own.join(forms.select("form", "key"), "form", "left").select("word", F.coalesce("key", "form").alias("key"))
