"""Queries of problem 2: the dates of documents and of their file metadata as UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import with_instant
from ..session import table


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, time_zone, slash_order: one row per source. The table is fixed (12 rows), so it is broadcast."""
    return F.broadcast(table(spark, sf_dir, "source_zones").dropDuplicates(["source"]))


def document_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, instant_us) of every document; null where the upload date denotes no instant."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "upload_date")
    return with_instant(docs.join(zones(spark, sf_dir), "source", "left"), "upload_date", "time_zone", "slash_order").select("doc_id", "instant_us")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "upload_date")
    meta = table(spark, sf_dir, "document_file_metadata").select("id", "document_id", "creation_date", "modification_date")
    dated = meta.join(docs.select(F.col("doc_id").alias("document_id"), "source"), "document_id", "left")
    pairs = F.array(
        F.struct(F.lit("creation_date").alias("field_name"), F.col("creation_date").alias("written")),
        F.struct(F.lit("modification_date").alias("field_name"), F.col("modification_date").alias("written")))
    values = docs.select(F.lit("upload_date").alias("field_name"), F.col("doc_id").alias("record_id"), "source", F.col("upload_date").alias("written")).unionByName(
        dated.select(F.explode(pairs).alias("v"), F.col("id").alias("record_id"), "source").select("v.*", "record_id", "source")
    ).filter(F.col("written").isNotNull())
    out = with_instant(values.join(zones(spark, sf_dir), "source", "left"), "written", "time_zone", "slash_order")
    return out.filter(F.col("instant_us").isNotNull()).select("field_name", "record_id", "instant_us")


QUERIES = {"p2_found": found}
