"""Documents read from files: a registry of parsers by extension, and folders scanned as binary files.

Text and .docx are parsed with the standard library. PDF needs a geometry library that is not part of this package:
register a parser for it. A file that can't be parsed becomes a row with its error and never fails the others.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paragraphs as P
from ..session import mapped

#: What a parser gives per paragraph: content, kind, style and heading level.
Raw = tuple[str, str, str | None, int | None]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_text(data: bytes) -> list[Raw]:
    """Blocks between blank lines."""
    return [(x.strip(), "unknown", None, None) for x in re.split(r"\n\s*\n", data.decode("utf-8", "replace")) if x.strip()]


def parse_docx(data: bytes) -> list[Raw]:
    """Paragraphs and tables in order; headings by style, table rows as cells between bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else x.text or "" for x in e.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))
    out: list[Raw] = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val") if style is not None else None
            level = re.match(r"Heading\s*(\d+)", name or "")
            if text(e).strip():
                out.append((text(e).strip(), "header" if level else "unknown", name, int(level[1]) if level else None))
        elif e.tag == f"{_W}tbl":
            rows = (" | ".join(text(c).strip() for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr"))
            out.append(("\n".join(rows), "table", None, None))
    return out


# Headings of tables of contents, the paragraphs among which one is looked for, and those looked at after it.
_TOC_NAMES, _TOC_WITHIN, _TOC_ENTRIES = ("table of contents", "contents", "toc"), 20, 50


def table_of_contents(raw: list[Raw]) -> list[tuple[int, str, str]]:
    """(position, content, kind) of the table of contents among the paragraphs of a file: its heading, one of the first
    paragraphs, and the entries after it, with dots and a page number each, up to the first other text."""
    texts = [(k, x[0]) for k, x in enumerate(raw) if x[1] != "table"]
    for n, (k, text) in enumerate(texts[:_TOC_WITHIN]):
        if text.lower().strip() in _TOC_NAMES:
            out = [(k, text, "toc")]
            for m, entry in texts[n + 1 : n + _TOC_ENTRIES]:
                if ".." in entry and re.search(r"\d+\s*$", entry):
                    out.append((m, entry, "toc_entry"))
                elif entry.strip():
                    break
            return out
    return []


def stored_names(uploads: DataFrame, order: str, stamp: str) -> DataFrame:
    """``uploads`` (order, filename) with ``stored``, the name to store each under: the first upload of a name keeps it,
    later ones get the time before the extension, and a number too from the third on. Names are numbered in one order
    over all rows, so a name that a scanner gives to a tenth of them is no single task. Null names drop out."""
    rows = P.numbered(uploads.filter("filename is not null"), [F.col("filename"), F.col(order)], "__at")
    first = rows.groupBy("filename").agg(F.min("__at").alias("__first"))
    n = F.col("__at") - F.col("__first")
    added = F.concat(F.lit(f"_{stamp}"), F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(""))
    dot = F.col("filename").contains(".")
    name = F.when(dot, F.concat(F.regexp_extract("filename", r"^(.*)\.[^.]*$", 1), added, F.lit("."), F.regexp_extract("filename", r"\.([^.]*)$", 1))).otherwise(F.concat(F.col("filename"), added))
    return rows.join(first, "filename").select(*uploads.columns, F.when(n == 0, F.col("filename")).otherwise(name).alias("stored"))


_parsers: dict[str, Callable[[bytes], list[Raw]]] = {"txt": parse_text, "docx": parse_docx}


def register_parser(extension: str, parse: Callable[[bytes], list[Raw]]) -> None:
    _parsers[extension.lower().lstrip(".")] = parse


def scan_folder(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, filename, file_type, file_size, modified, content) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("file_type"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), "content")


def parsed(files: DataFrame) -> DataFrame:
    """(path, position, content, paragraph_type, style, level, error): the paragraphs of each file, or its error."""
    parsers = dict(_parsers)

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if kind not in parsers:
                        raise ValueError(f"no parser for .{kind} files")
                    rows += [(path, k, *x, None) for k, x in enumerate(parsers[kind](data))]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["path", "position", "content", "paragraph_type", "style", "level", "error"])

    return mapped(files.select("path", "file_type", "content"), stream, "path string, position int, content string, paragraph_type string, style string, level int, error string")
