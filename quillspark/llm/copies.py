"""Paragraphs that are copies but for formatting (problem 5), which copies print the same (problem 3), and the best
representative of each group of copies (problem 1).

Values are dictionary-encoded: every content is canonicalised into field values, each value held more than once gets an
integer, records are rewritten as sorted tuples of these integers, and equal tuples are grouped.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.p2_timestamps import document_instants
from ..session import cut, mapped, spread, table
from .form import MEMBERS, Form, MemberCounter, formed, learned, letters_digits

#: Fewer letters and digits than this make no group.
MIN_LETTERS_DIGITS = 60
_CELL = re.compile(r"[|\n\r\x0b\x0c\x85\u2028\u2029]+")
_FIELDS = "row long, id long, document_id long, is_table boolean, form binary, raw binary, fields array<binary>, " + MEMBERS


def record(content: str, is_table: bool, form: Form) -> tuple[str, list[str]]:
    """The consistent form of a content, and its canonical field values: the cells of a table in any order, else the
    letters and digits of the whole. Blank fields drop out."""
    text = form(content)
    if is_table:
        return text, sorted(x for x in map(letters_digits, _CELL.split(text)) if x)
    whole = letters_digits(text)
    return text, [whole] if whole else []


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def fields(paragraphs: DataFrame, form: Form, least: int = MIN_LETTERS_DIGITS) -> DataFrame:
    """Of one pass over the contents: a row per paragraph with at least ``least`` letters and digits in its form, and
    the rows that :func:`~.form.formed` counts.

    ``row`` numbers the rows, ``fields`` holds the 128-bit digests of the canonical field values, ``form`` and ``raw``
    those of the consistent form and of the content as stored. Each distinct content of a batch is canonicalised once.
    Null and short contents have no row; null types are no tables.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 33) - 1
        members = MemberCounter()
        names = [x.split()[0] for x in _FIELDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.string(), pa.int64()]
        for batch in batches:
            ids, documents, content, is_table = (batch.column(k).to_pylist() for k in range(4))
            members.add(content)
            done: dict = {}
            rows = []
            for i, d, c, t in zip(ids, documents, content, is_table):
                if c is None:
                    continue
                got = done.get((c, t))
                if got is None:
                    got = ()
                    text, values = record(c, t, form)
                    if sum(map(len, values)) >= least:
                        got = _digest(text), _digest(c), [_digest(x) for x in values]
                    done[c, t] = got
                if got:
                    number += 1
                    rows.append((number, i, d, t, *got, None, None))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        counts = members.counts()
        n = len(counts)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(n, k) for k in kinds[:-2]), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names)

    kind = F.coalesce(F.lower("paragraph_type") == "table", F.lit(False))
    return mapped(spread(paragraphs.select(F.col("id").cast("long"), F.col("document_id").cast("long"), F.col("content"), kind.alias("t"))), scan, _FIELDS)


def dictionary(rows: DataFrame) -> DataFrame:
    """(value, code): an integer for each field value that several fields hold. A record with a value that stands once
    equals no other, so such values need none. The integers are given once and written, so retries don't change them."""
    values = rows.select(F.explode("fields").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return cut(values.select("value", F.monotonically_increasing_id().alias("code")), "dictionary")


def keyed(rows: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """(row, id, document_id, key, form, raw) of the ``rows`` of :func:`fields` all of whose values have a code. ``key``
    is the record itself: whether it is a table, and the sorted integers of its field values."""
    codes = dictionary(rows) if codes is None else codes
    flag = F.col("is_table").cast("long")
    one = rows.filter("size(fields) = 1").select("row", "id", "document_id", "form", "raw", flag.alias("flag"), F.col("fields")[0].alias("value"))
    simple = one.join(codes, "value").select("row", "id", "document_id", F.array("flag", "code").alias("key"), "form", "raw")
    # the cells of one content come together again, as many as it has; a row with fewer has a value of its own
    many = rows.filter("size(fields) > 1")
    cells = many.select("row", F.size("fields").alias("size"), F.explode("fields").alias("value")).join(codes, "value")
    whole = cells.groupBy("row", "size").agg(F.sort_array(F.collect_list("code")).alias("codes")).filter("size(codes) = size").select("row", "codes")
    tabular = many.join(whole, "row").select("row", "id", "document_id", F.concat(F.array(flag), "codes").alias("key"), "form", "raw")
    return simple.unionByName(tabular)


def groups(keys: DataFrame) -> DataFrame:
    """(key, group_id, copies): the groups of equal keys with two or more ids; counted partly before the shuffle. A
    row that is merely repeated is no group of its own."""
    found = keys.groupBy("key").agg(F.min("id").alias("group_id"), F.max("id").alias("last"), F.count(F.lit(1)).alias("copies"))
    return found.filter("group_id < last").drop("last")


def members(keys: DataFrame) -> DataFrame:
    """``keys`` of all members of groups, with group_id. A group of any size is spread over tasks by the skew join."""
    return keys.join(groups(keys), "key")


def paragraph_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`fields` of the paragraphs, in the form most frequent in them."""
    paragraphs = table(spark, sf_dir, "paragraphs")
    return formed(lambda form: fields(paragraphs, form), "copy-fields")[0].filter("row is not null")


def paragraph_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(keyed(paragraph_fields(spark, sf_dir)), "copy-keys")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every member of a group but the smallest id, which names the group."""
    return members(paragraph_keys(spark, sf_dir)).filter("id <> group_id").select("group_id", F.col("id").alias("paragraph_id"))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct record of 60 or more letters and digits, with its number of copies and of documents."""
    rows = paragraph_fields(spark, sf_dir)
    keys = cut(keyed(rows), "copy-keys")
    per_document = keys.groupBy("key", "document_id").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    shared = per_document.groupBy("key").agg(F.min("id").alias("record_id"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("documents")).drop("key")
    # a row without a key has a value of its own, and is the only one of its record
    alone = rows.join(keys, "row", "left_anti").select(F.col("id").alias("record_id"), F.lit(1).cast("long").alias("copies"), F.lit(1).cast("long").alias("documents"))
    return shared.unionByName(alone)


def printed_alike(keys: DataFrame) -> DataFrame:
    """Pairs (paragraph_a, paragraph_b) of one group and one consistent form that are stored differently. Only forms
    stored in two or more ways take part in the join, which is on form and group and so yields nothing but results."""
    forms = keys.groupBy("key", "form").agg(F.min("raw").alias("x"), F.max("raw").alias("y")).filter("x <> y").select("key", "form")
    some = keys.join(forms, ["key", "form"]).select("key", "form", "raw", "id")
    a, b = (some.select("key", "form", F.col("raw").alias(f"raw_{x}"), F.col("id").alias(f"paragraph_{x}")) for x in "ab")
    return a.join(b, ["key", "form"]).filter("paragraph_a < paragraph_b and raw_a <> raw_b").select("paragraph_a", "paragraph_b")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed_alike(paragraph_keys(spark, sf_dir))


def p3_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content, changed) of every paragraph: the content in its consistent form."""
    paragraphs = table(spark, sf_dir, "paragraphs")
    return consistent(paragraphs.select("id", "content"), "content", learned(paragraphs, "content"))


def consistent(df: DataFrame, column: str, form: Form) -> DataFrame:
    """``df`` with a text column in consistent form, and ``changed``. Null stays null, unchanged."""
    from pyspark.sql.types import BooleanType, StructField, StructType

    at = df.columns.index(column)

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [x if x is None else form(x) for x in old]
            columns = [pa.array(new, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x != y for x, y in zip(old, new)], pa.bool_())], [*batch.schema.names, "changed"])

    return mapped(spread(df), rewrite, StructType([*df.schema.fields, StructField("changed", BooleanType())]))


def best(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group in a total order. Spark keeps only each task's first row per group before it
    shuffles (WindowGroupLimit), so a group of any size costs one row per task."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("__rank = 1").drop("__rank")


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column]]:
    """Members of groups with header and upload instant, and the order in which their values are preferred."""
    found = members(paragraph_keys(spark, sf_dir)).select("id", "group_id", "document_id", (F.col("raw") == F.col("form")).alias("trusted"))
    headers = table(spark, sf_dir, "paragraphs").select("id", "header_content")
    blank = F.coalesce(~F.col("header_content").rlike(r"(?U)\S"), F.lit(True))
    rows = found.join(headers.select("id", F.when(~blank, F.col("header_content")).alias("header")), "id").join(
        document_instants(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "instant_us"), "document_id", "left")
    return rows, [F.col("instant_us").desc_nulls_last(), F.col("id")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, order = _ranked(spark, sf_dir)
    rows = cut(rows.select("group_id", "id", F.col("header").isNotNull().alias("headed"), "instant_us"), "ranked")
    survivors = best(rows, "group_id", order).select("group_id", F.col("id").alias("survivor_id"))
    headers = best(rows.filter("headed"), "group_id", order).select("group_id", F.col("id").alias("header_id"))
    return survivors.join(headers, "group_id", "left").select("group_id", "survivor_id", F.coalesce("header_id", F.lit(0)).alias("header_id"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per group of copies, every field the best on offer, with the number of copies.

    The document and its instant are those of the latest member, as in :func:`p1_found`; the header is the first
    non-blank one in the same order. The content is ranked by completeness (a member with header and instant before one
    that lacks any), trust (content stored in its consistent form before one that had to be rewritten), recency and id:
    ``content_id`` is the member it is from."""
    rows, order = _ranked(spark, sf_dir)
    rows = cut(rows, "ranked-records")
    survivors = best(rows, "group_id", order).select("group_id", "id", "document_id", "instant_us")
    headers = best(rows.filter("header is not null"), "group_id", order).select("group_id", F.col("header").alias("header_content"))
    complete = F.col("header").isNotNull().cast("int") + F.col("instant_us").isNotNull().cast("int")
    contents = best(rows, "group_id", [complete.desc(), F.col("trusted").desc(), *order]).select("group_id", F.col("id").alias("content_id"))
    counts = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("copies"))
    texts = table(spark, sf_dir, "paragraphs").select(F.col("id").alias("content_id"), "content")
    return survivors.join(counts, "group_id").join(headers, "group_id", "left").join(contents, "group_id").join(texts, "content_id").select(
        "group_id", F.col("id").alias("survivor_id"), "document_id", "instant_us", "header_content", "content_id", "content", "copies")


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p3_found": p3_found, "p3_consistent": p3_consistent, "p5_found": p5_found, "p5_records": p5_records}
