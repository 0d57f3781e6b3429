"""The layout of pages, on a table of blocks: what stands where, in how many columns, and what kind it is.

A block is a row (document_id, page_no, block_no, x0, y0, x1, y1, page_width, page_height, content), with font_size and
is_bold where kinds are told; y grows downwards. Tables are rows (document_id, page_no, x0, y0, x1, y1). Blocks with a
null edge overlap nothing and take no part in columns; pages without blocks have no row. A page is the unit of all
windows, so no document gathers in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

C = F.col
PAGE = ["document_id", "page_no"]
#: Blocks a page of columns has at least, all and with text, bars of the histogram, and its middle part.
LEAST_BLOCKS, LEAST_TEXT, BARS, MIDDLE = 10, 5, 20, (6, 14)
#: Gaps and columns narrower than these shares of the page's width don't count.
GAP, COLUMN = 0.05, 0.15


def outside_tables(blocks: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Blocks without those of which a single table covers more than ``share``. A page has few tables, but blocks and
    tables of a page meet only if their heights do."""
    t = tables.select(*PAGE, *[C(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    over = lambda a, b: F.greatest(F.least(f"{a}1", f"t_{a}1") - F.greatest(f"{b}0", f"t_{b}0"), F.lit(0.0))
    area = (C("x1") - C("x0")) * (C("y1") - C("y0"))
    covered = blocks.join(t, PAGE).filter((area > 0) & (over("x", "x") * over("y", "y") / area > share)).select(*PAGE, "block_no").distinct()
    return blocks.join(covered, [*PAGE, "block_no"], "left_anti")


def zoned(blocks: DataFrame, kind: str = "kind") -> DataFrame:
    """Blocks with ``kind`` replaced by header or footer for short contents in the first or last tenth of the page."""
    short = F.length("content") < 100
    return blocks.withColumn(kind, F.when((C("y0") < C("page_height") * 0.1) & short, "header").when((C("y0") > C("page_height") * 0.9) & short, "footer").otherwise(C(kind)))


def block_kinds(blocks: DataFrame) -> DataFrame:
    """Non-blank blocks with ``kind`` and ``level``: list if a line is a list item, toc_entry, header by a bold font of
    more than 10 points or one of more than 14 (level 1 beyond 16, else 2), and paragraph."""
    bold = F.coalesce(C("is_bold"), F.lit(False))
    large = F.coalesce((bold & (C("font_size") > 10)) | (C("font_size") > 14), F.lit(False))
    kind = F.when(T.has_list_item("content"), "list").when(T.is_toc_entry("content"), "toc_entry").when(large, "header").otherwise("paragraph")
    return blocks.filter(F.trim("content") != "").withColumn("kind", kind).withColumn("level", F.when(large, F.when(C("font_size") > 16, 1).otherwise(2)))


def in_order(blocks: DataFrame) -> DataFrame:
    """Blocks with ``place``, their number on the page from the top, from 0; by block number where heights are equal."""
    return blocks.withColumn("place", (F.row_number().over(Window.partitionBy(*PAGE).orderBy(C("y0").asc_nulls_first(), "block_no")) - 1).cast("long"))


def _has_text() -> Column:
    return F.coalesce(F.trim("content") != "", F.lit(False))


def several_columns(blocks: DataFrame) -> DataFrame:
    """(document_id, page_no, several): whether a page surely has columns. Midpoints of its blocks with text fall into
    BARS bars between the least and the greatest; a bar of the middle is nearly empty, more than three blocks stand on
    either side, and seven tenths of the blocks are narrower than two fifths of the page."""
    rows = blocks.withColumn("text", _has_text()).withColumn("mid", F.when(C("text"), (C("x0") + C("x1")) / 2))
    page = Window.partitionBy(*PAGE)
    low, high = F.min("mid").over(page), F.max("mid").over(page)
    bar = F.when(high > low, F.least(F.floor((C("mid") - low) / (high - low) * BARS), F.lit(BARS - 1))).otherwise(BARS // 2)
    rows = rows.withColumn("bar", F.when(C("mid").isNotNull(), bar))
    at = [F.count_if(C("bar") == k).alias(f"b{k}") for k in range(BARS)]
    per = rows.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("blocks"), F.count_if("text").alias("texts"), F.count_if(C("text") & (C("x1") - C("x0") < 0.4 * C("page_width"))).alias("narrow"), *at)
    middle = [C(f"b{k}") for k in range(*MIDDLE)]
    side = lambda ks: sum((C(f"b{k}") for k in ks), F.lit(0))
    several = ((C("blocks") >= LEAST_BLOCKS) & (C("texts") >= LEAST_TEXT) & (F.least(*middle) < 0.1 * F.greatest(*[C(f"b{k}") for k in range(BARS)]))
               & (side(range(MIDDLE[0])) > 3) & (side(range(MIDDLE[1], BARS)) > 3) & (C("narrow") >= 0.7 * C("texts")))
    return per.select(*PAGE, several.alias("several"))


def column_bounds(blocks: DataFrame) -> DataFrame:
    """(document_id, page_no, column_no, from_x, to_x): the columns between the gaps that no block with text covers. Gaps
    wider than GAP of the page count, those less than that apart are one, columns of COLUMN of the page or less drop
    out; a page with fewer than two columns or LEAST_TEXT blocks with text has none.

    The edges of blocks are swept by a running number of open blocks, starts after ends of the same place."""
    rows = blocks.filter(_has_text() & C("x0").isNotNull() & C("x1").isNotNull())
    page = Window.partitionBy(*PAGE)
    rows = rows.withColumn("texts", F.count(F.lit(1)).over(page)).filter(C("texts") >= LEAST_TEXT)
    edges = rows.select(*PAGE, "page_width", F.explode(F.array(F.struct(C("x0").alias("x"), F.lit(1).alias("step")), F.struct(C("x1").alias("x"), F.lit(-1).alias("step")))).alias("e")).select(*PAGE, "page_width", "e.*")
    sweep = Window.partitionBy(*PAGE).orderBy("x", "step")
    swept = edges.select(*PAGE, "page_width", "x", F.sum("step").over(sweep.rowsBetween(Window.unboundedPreceding, 0)).alias("open"), F.lead("x").over(sweep).alias("next"))
    gaps = swept.filter((C("open") == 0) & (C("next") - C("x") > GAP * C("page_width"))).select(*PAGE, "page_width", C("x").alias("begin"), C("next").alias("end"))
    before = Window.partitionBy(*PAGE).orderBy("begin")
    apart = F.coalesce(C("begin") - F.lag("end").over(before) >= GAP * C("page_width"), F.lit(True))
    merged = gaps.withColumn("gap", F.sum(apart.cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*PAGE, "page_width", "gap").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    # a column ends where a gap begins; the last one ends with the page
    starts = merged.withColumn("from_x", F.coalesce(F.lag("end").over(before), F.lit(0.0)))
    last = merged.groupBy(*PAGE, "page_width").agg(F.max("end").alias("from_x")).select(*PAGE, "page_width", "from_x", C("page_width").alias("to_x"))
    columns = starts.select(*PAGE, "page_width", "from_x", C("begin").alias("to_x")).unionByName(last).filter(C("to_x") - C("from_x") > COLUMN * C("page_width"))
    numbered = columns.select(*PAGE, (F.row_number().over(Window.partitionBy(*PAGE).orderBy("from_x")) - 1).cast("long").alias("column_no"), "from_x", "to_x", F.count(F.lit(1)).over(page).alias("n"))
    return numbered.filter("n > 1").drop("n")


def scanned_documents(pages: DataFrame, first: int = 3, least: int = 50) -> DataFrame:
    """(document_id, scanned): whether fewer than half of a document's first pages hold more than ``least`` characters.
    ``pages`` has document_id, page_no from 0, content."""
    some = pages.filter(C("page_no") < first).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.trim("content")) > least).alias("k"))
    return some.select("document_id", (C("k") < C("n") / 2).alias("scanned"))


def valid_columns(elements: DataFrame) -> DataFrame:
    """(document_id, page_no, column_no, valid): whether a column holds three elements or more and fewer than half of
    them are fragments: paragraphs of under 50 characters without punctuation at the end."""
    fragment = (C("kind") == "paragraph") & (F.length("content") < 50) & (C("content") != "") & ~F.substring("content", -1, 1).isin(*".?!:;")
    per = elements.groupBy(*PAGE, "column_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(fragment, F.lit(False))).alias("fragments"))
    return per.select(*PAGE, "column_no", ((C("n") >= 3) & (C("fragments") < C("n") * 0.5)).alias("valid"))


def in_columns(blocks: DataFrame, columns: DataFrame) -> DataFrame:
    """(document_id, page_no, block_no, column_no): the column that holds a block's middle, for pages with columns."""
    middle = (C("x0") + C("x1")) / 2
    return blocks.join(columns, PAGE).filter((middle >= C("from_x")) & (middle < C("to_x"))).select(*PAGE, "block_no", "column_no")
