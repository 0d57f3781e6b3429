"""Tables of a relational database, read over JDBC in ranges of a key, so that no task reads a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def jdbc_options(url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, fetch: int = 10_000, **more: str) -> dict[str, str]:
    """The options of a JDBC read. Rows outside ``low`` to ``high`` are read too, by the first and last range."""
    ranges = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(max(high, low + 1)), "numPartitions": str(parts)} if key else {}
    return {"url": url, "dbtable": name, "fetchsize": str(fetch), **ranges, **more}


def jdbc_table(spark: SparkSession, url: str, name: str, key: str = "id", parts: int = 64, **more: str) -> DataFrame:
    """The table ``name`` of a database, in ``parts`` ranges of its numeric key between the least and the greatest. Filters
    and columns are pushed down to the database."""
    ship(spark)
    ends = spark.read.format("jdbc").options(**jdbc_options(url, f"(select min({key}) as low, max({key}) as high from {name}) ends", **more)).load().first()
    if ends is None or ends[0] is None:
        return spark.read.format("jdbc").options(**jdbc_options(url, name, **more)).load()
    return spark.read.format("jdbc").options(**jdbc_options(url, name, key, int(ends[0]), int(ends[1]), parts, **more)).load()
