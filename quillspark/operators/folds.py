"""Ordered folds: runs merged, elements attached to their introductions, long texts split, contents packed into pages.

A fold is cut where its state begins anew, whatever came before; the segments between the cuts are spread over tasks,
rows stream through them in order, and only the element at hand is kept. Packing has no such places, as each page
depends on all pages before it in the document; there every stretch of rows is folded from all states it may be
entered in, and the stretches are then put together by their states.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, mapped
from . import paragraphs as P

C = F.col
_SENTENCE_END = re.compile(r"[.!?]\s+")


def split_long(text: str, target: int = 500) -> list[str]:
    """A text cut after sentences. A piece ends where the lengths from its start to each sentence end so far add up to
    ``target``, so pieces of several sentences stay shorter than that."""
    pieces, start, added = [], 0, 0
    for m in _SENTENCE_END.finditer(text):
        added += m.end() - start
        if added >= target:
            pieces.append(text[start : m.end()].strip())
            start, added = m.end(), 0
    if start < len(text) or not pieces:
        pieces.append(text[start:].strip() if start else text)
    return pieces


def packed(contents: Iterable[str], most: int = 3000) -> Iterator[str]:
    """Contents joined line by line into pages of ``most`` characters, line ends not counted; a longer one has its own."""
    page: list[str] = []
    used = 0
    for c in contents:
        if used + len(c) > most and page:
            yield "\n".join(page)
            page, used = [], 0
        page.append(c)
        used += len(c)
    if page:
        yield "\n".join(page)


def attached(rows: Iterable[tuple[int, str, str, int | None]]) -> Iterator[tuple[int, str, str]]:
    """(id, kind, content) of one document's rows (id, kind, content, column): a list or table after a paragraph that
    ends with a colon is put under it if the columns don't differ; other neighbours of one kind are merged."""
    done: tuple | None = None
    element: tuple | None = None
    for i, kind, content, column in rows:
        if kind in ("list", "table"):
            if element is None and done is not None and done[2].strip().endswith(":") and (done[3] is None or column is None or done[3] == column):
                done = (done[0], done[1], f"{done[2]}\n{content}", done[3])
            elif element is not None and element[1] == kind:
                element = (element[0], kind, f"{element[2]}\n{content}", element[3])
            else:
                yield from (x[:3] for x in (done, element) if x is not None)
                done, element = None, (i, kind, content, column)
        else:
            yield from (x[:3] for x in (done, element) if x is not None)
            done, element = (i, kind, content, column), None
    yield from (x[:3] for x in (done, element) if x is not None)


def _stream(rows: DataFrame, by: str, columns: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fold`` over the rows of each value of ``by``, which come in order; its tuples are the result."""
    parts = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(list(zip(*out)) or [()] * len(parts), parts)], [n for n, _ in parts])
        for _, held in groupby(all_rows(), key=lambda r: r[0]):
            for x in fold(r[1:] for r in held):
                out.append(x)
                if len(out) == 5000:
                    yield pack()
                    out = []
        yield pack()

    return mapped(rows.select(by, *columns), stream, schema)


def by_segment(rows: DataFrame, columns: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fold`` over the rows of each segment, see :func:`~.paragraphs.segments`, in the order of places."""
    ordered = rows.repartition("segment").sortWithinPartitions("segment", "place")
    return _stream(ordered, "segment", columns, fold, schema)


def _ordered(paragraphs: DataFrame, columns: list[str], previous: list[str]) -> DataFrame:
    return P.before_each(paragraphs.select("document_id", "para_position", *columns), ["document_id"], [C("para_position").asc_nulls_first(), C("id")], previous)


def merged_runs(paragraphs: DataFrame, kinds: tuple[str, ...] = ("list", "table")) -> DataFrame:
    """(document_id, id, content, merged): runs of neighbours of one of ``kinds`` as one paragraph, the others alone. A
    merged content is as long as its run; null contents are left out of it."""
    rows = _ordered(paragraphs, ["id", "paragraph_type", "content"], ["paragraph_type"])
    same = F.coalesce((C("previous_paragraph_type") == C("paragraph_type")) & C("paragraph_type").isin(*kinds), F.lit(False))

    def fold(held: Iterator[tuple]) -> Iterator[tuple]:
        document, first, content = next(held)
        contents, n = [] if content is None else [content], 1
        for _, _, c in held:
            contents += [] if c is None else [c]
            n += 1
        yield document, first, "\n".join(contents), n

    return by_segment(P.segments(rows, ~same), ["document_id", "id", "content"], fold, "document_id long, id long, content string, merged long")


def attach_elements(paragraphs: DataFrame) -> DataFrame:
    """(document_id, id, kind, content): see :func:`attached`. A paragraph that is no list or table begins anew, so does
    a document; rows of null content are left out."""
    rows = _ordered(paragraphs.filter("content is not null"), ["id", "paragraph_type", "content", "column_no"], ["id"])
    starts = C("previous_id").isNull() | ~F.coalesce(C("paragraph_type").isin("list", "table"), F.lit(False))

    def fold(held: Iterator[tuple]) -> Iterator[tuple]:
        first = next(held)
        for x in attached(r[1:] for r in chain([first], held)):
            yield first[0], *x

    return by_segment(P.segments(rows, starts), ["document_id", "id", "paragraph_type", "content", "column_no"], fold, "document_id long, id long, kind string, content string")


#: Rows folded at a stretch when pages are packed.
STRETCH = 20_000


def page_starts(lengths: list[int], used: int | None, most: int) -> list[bool]:
    """Which of the rows of these lengths begin a page, if ``used`` characters stand on the page before them (None:
    there is none)."""
    out = []
    for n in lengths:
        out.append(used is None or used + n > most)
        used = n if out[-1] else used + n
    return out


def entries(lengths: list[int], most: int) -> tuple[list[int], list[int], list[int]]:
    """(reach, left, pages) of the rows that may be the first of a stretch to begin a page, whatever stood on the page
    before: the characters up to and with the row, and how many characters the stretch leaves on its last page after how
    many new ones. A page before with u characters goes on until the first row whose reach exceeds ``most - u``; what
    follows depends on that row alone, so the rows are worked out once, from the last to the first."""
    reach = list(accumulate(lengths))
    left, pages, after = [0] * len(lengths), [0] * len(lengths), len(lengths)
    for k in range(len(lengths) - 1, -1, -1):
        before = reach[k] - lengths[k]
        # the page from row k on ends at the first row that doesn't fit
        while after - 1 > k and reach[after - 1] - before > most:
            after -= 1
        if after < len(lengths) and after > k and reach[after] - before > most:
            left[k], pages[k] = left[after], pages[after] + 1
        else:
            left[k], pages[k] = reach[-1] - before, 1
    some = sum(1 for k in range(len(lengths)) if reach[k] - lengths[k] <= most)
    return reach[:some], left[:some], pages[:some]


def packed_pages(paragraphs: DataFrame, most: int = 3000, stretch: int = STRETCH) -> DataFrame:
    """(document_id, page_number, content): each document's contents packed into pages, see :func:`packed`. Blank
    contents are left out. Stretches of ``stretch`` rows are folded on their own for every state they may be entered in;
    a document's task sees one row per stretch."""
    rows = paragraphs.filter("trim(content) <> ''").select("document_id", "para_position", "id", "content", F.length("content").alias("n"))
    placed = cut(P.numbered(rows, [C("document_id").asc_nulls_first(), C("para_position").asc_nulls_first(), C("id")], "place"), "placed")
    first = placed.groupBy(C("document_id").alias("__d")).agg(F.min("place").alias("first"))
    held = cut(placed.join(first, C("document_id").eqNullSafe(C("__d"))).withColumn("at", C("place") - F.pmod(C("place") - C("first"), F.lit(stretch))).select("document_id", "at", "place", "first", "content", "n"), "stretches")
    in_order = lambda df, by, *more: df.repartition(by).sortWithinPartitions(by, *more)

    def summed(rows: Iterator[tuple]) -> Iterator[tuple]:
        document, at, begin, lengths = None, 0, False, []
        for document, at, begins, n in rows:
            begin = at == begins
            lengths.append(n)
        yield document, at, begin, *entries(lengths, most), sum(lengths)

    whole = _stream(in_order(held.select("at", "document_id", "first", "n", "place"), "at", "place"), "at", ["document_id", "at", "first", "n"], summed,
                    "document_id long, at long, begin boolean, reach array<int>, left_over array<int>, pages array<int>, total long")

    def chained(rows: Iterator[tuple]) -> Iterator[tuple]:
        used, done = None, 0
        for at, begin, reach, left, pages, total in rows:
            if begin:
                used, done = None, 0
            yield at, used, done
            k = 0 if used is None else bisect_right(reach, most - used)
            if k < len(reach):
                used, done = left[k], done + pages[k]
            else:
                used += total

    states = _stream(in_order(whole, "document_id", "at"), "document_id", ["at", "begin", "reach", "left_over", "pages", "total"], chained, "at long, used long, done long")

    def numbered(rows: Iterator[tuple]) -> Iterator[tuple]:
        rows = list(rows)
        used, done = rows[0][-2:]
        for begins, (document, place, content, *_) in zip(page_starts([len(r[2]) for r in rows], used, most), rows):
            done += begins
            yield document, done - 1, place, content

    pages = _stream(in_order(held.join(states, "at"), "at", "place"), "at", ["document_id", "place", "content", "used", "done"], numbered, "document_id long, page_number long, place long, content string")
    # a page holds at most ``most`` rows
    return pages.groupBy("document_id", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]), "\n").alias("content"))


def split_texts(rows: DataFrame) -> DataFrame:
    """(id, piece, content): each content split after sentences."""
    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, k, x) for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if c for k, x in enumerate(split_long(c))]
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string()))], ["id", "piece", "content"])
    return mapped(rows.select("id", "content"), stream, "id long, piece int, content string")
