"""Paragraphs that arrive as a stream, each exact match once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import exact_key


def first_seen(stream: DataFrame, arrived: str, delay: str = "1 hour") -> DataFrame:
    """A stream's paragraphs without those whose exact key came before within the watermark; the state holds hashes."""
    keyed = stream.withColumn("key_hash", F.xxhash64(exact_key("content"))).withWatermark(arrived, delay)
    return keyed.dropDuplicatesWithinWatermark(["key_hash"])
