"""Page layout by its survey names, with SQL, on blocks laid out from the paragraphs: twenty to a page, those of every
third document in two columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout as L
from ..session import table

C, SQL, QUERIES = F.col, {}, {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(spark, lambda t: table(spark, sf_dir, t))
        if sql:
            SQL[name] = sql
        return build
    return add


_X0 = "50.0 + 280 * case when document_id % 3 = 0 then para_position % 2 else 0 end"
_BLOCKS = f"""blocks as (select document_id, para_position // 20 as page_no, id as block_no, {_X0} as x0, 20.0 + 40 * (para_position % 20) as y0,
{_X0} + 60 + length(content) % 170 as x1, 50.0 + 40 * (para_position % 20) as y1, 600.0 as page_width, 840.0 as page_height, 8.0 + id % 11 as font_size, id % 5 = 0 as is_bold, content,
paragraph_type from paragraphs where content is not null and document_id is not null and para_position is not null)"""


def blocks(paragraphs):
    """The blocks of the paragraphs, as the SQL has them."""
    rows = paragraphs.filter("content is not null and document_id is not null and para_position is not null")
    x0 = F.lit(50.0) + 280 * F.when(C("document_id") % 3 == 0, C("para_position") % 2).otherwise(0)
    row = C("para_position") % 20
    return rows.select("document_id", F.floor(C("para_position") / 20).cast("long").alias("page_no"), C("id").alias("block_no"), x0.alias("x0"), (F.lit(20.0) + 40 * row).alias("y0"),
                       (x0 + 60 + F.length("content") % 170).alias("x1"), (F.lit(50.0) + 40 * row).alias("y1"), F.lit(600.0).alias("page_width"), F.lit(840.0).alias("page_height"),
                       (F.lit(8.0) + C("id") % 11).alias("font_size"), (C("id") % 5 == 0).alias("is_bold"), "content", "paragraph_type")


_TABLES = "tables as (select document_id, page_no, x0 - 5 as x0, y0 - 30 as y0, x1 + 40 as x1, y1 + 25 as y1 from blocks where paragraph_type = 'table')"


@query("F17_outside_tables", f"""with {_BLOCKS}, {_TABLES} select document_id, page_no, block_no from blocks b where not exists (select 1 from tables t where t.document_id = b.document_id and t.page_no = b.page_no
and greatest(least(b.x1, t.x1) - greatest(b.x0, t.x0), 0) * greatest(least(b.y1, t.y1) - greatest(b.y0, t.y0), 0) / ((b.x1 - b.x0) * (b.y1 - b.y0)) > 0.5)""")
def _(spark, t):
    b = blocks(t("paragraphs"))
    rects = b.filter("paragraph_type = 'table'").select("document_id", "page_no", (C("x0") - 5).alias("x0"), (C("y0") - 30).alias("y0"), (C("x1") + 40).alias("x1"), (C("y1") + 25).alias("y1"))
    return L.outside_tables(b, rects).select("document_id", "page_no", "block_no")


@query("T11_zones", f"with {_BLOCKS} select block_no, case when y0 < page_height * 0.1 and length(content) < 100 then 'header' when y0 > page_height * 0.9 and length(content) < 100 then 'footer' else paragraph_type end as kind from blocks")
def _(spark, t):
    return L.zoned(blocks(t("paragraphs")), "paragraph_type").select("block_no", C("paragraph_type").alias("kind"))


_ITEMS = rf"(len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(trim(regexp_replace(x, '{T.SPACE}+', ' ', 'g')), '{T.LIST_ITEM}'))) > 0)"
_KINDS = rf"""kinds as (select *, case when {_ITEMS} then 'list' when contains(content, '..') and regexp_matches(content, '\d+\s*$') then 'toc_entry' when (is_bold and font_size > 10) or font_size > 14 then 'header' else 'paragraph' end as kind,
case when (is_bold and font_size > 10) or font_size > 14 then case when font_size > 16 then 1 else 2 end end as level from blocks where trim(content) <> '')"""


@query("T12_O7_block_kinds", f"with {_BLOCKS}, {_KINDS} select block_no, kind, level, row_number() over (partition by document_id, page_no order by y0, block_no) - 1 as place from kinds")
def _(spark, t):
    return L.in_order(L.block_kinds(blocks(t("paragraphs")))).select("block_no", "kind", "level", "place")


_COUNTS = ", ".join(f"count(*) filter (bar = {k}) as b{k}" for k in range(20))
_BARS = lambda a, b: ", ".join(f"b{k}" for k in range(a, b))
_SEVERAL = f"""mids as (select *, case when trim(content) <> '' then (x0 + x1) / 2 end as mid from blocks), ends as (select *, min(mid) over w as low, max(mid) over w as high from mids window w as (partition by document_id, page_no)),
bars as (select *, case when mid is not null then case when high > low then least(floor((mid - low) / (high - low) * 20), 19) else 10 end end as bar from ends),
per as (select document_id, page_no, count(*) as n, count(mid) as texts, count(*) filter (mid is not null and x1 - x0 < 0.4 * page_width) as narrow, {_COUNTS} from bars group by document_id, page_no)"""


@query("T13_several_columns", f"""with {_BLOCKS}, {_SEVERAL} select document_id, page_no, n >= 10 and texts >= 5 and least({_BARS(6, 14)}) < 0.1 * greatest({_BARS(0, 20)})
and {_BARS(0, 6).replace(", ", " + ")} > 3 and {_BARS(14, 20).replace(", ", " + ")} > 3 and narrow >= 0.7 * texts as several from per""")
def _(spark, t):
    return L.several_columns(blocks(t("paragraphs")))


_COLUMNS = """rows as (select *, count(*) over (partition by document_id, page_no) as texts from blocks where trim(content) <> ''),
edges as (select document_id, page_no, page_width, x0 as x, 1 as step from rows where texts >= 5 union all select document_id, page_no, page_width, x1, -1 from rows where texts >= 5),
swept as (select *, sum(step) over (partition by document_id, page_no order by x, step rows unbounded preceding) as open, lead(x) over (partition by document_id, page_no order by x, step) as next from edges),
gaps as (select document_id, page_no, page_width, x as b, next as e from swept where open = 0 and next - x > 0.05 * page_width),
marked as (select *, case when b - lag(e) over (partition by document_id, page_no order by b) < 0.05 * page_width then 0 else 1 end as apart from gaps),
merged as (select document_id, page_no, page_width, min(b) as b, max(e) as e from (select *, sum(apart) over (partition by document_id, page_no order by b rows unbounded preceding) as gap from marked) group by document_id, page_no, page_width, gap),
cols as (select document_id, page_no, page_width, coalesce(lag(e) over (partition by document_id, page_no order by b), 0) as from_x, b as to_x from merged union all select document_id, page_no, page_width, max(e), page_width from merged group by document_id, page_no, page_width),
wide as (select *, count(*) over (partition by document_id, page_no) as n from cols where to_x - from_x > 0.15 * page_width),
columns_found as (select document_id, page_no, row_number() over (partition by document_id, page_no order by from_x) - 1 as column_no, from_x, to_x from wide where n > 1)"""


@query("W7_S13_column_bounds", f"with {_BLOCKS}, {_COLUMNS} select document_id, page_no, column_no, from_x::double as from_x, to_x::double as to_x from columns_found")
def _(spark, t):
    return L.column_bounds(blocks(t("paragraphs")))


@query("T14_scanned_documents", f"""with {_BLOCKS}, pages as (select document_id, page_no, string_agg(content, ' ' order by block_no) as content from blocks where page_no < 3 group by document_id, page_no)
select document_id, count(*) filter (length(trim(content)) > 50) < count(*) / 2 as scanned from pages group by document_id""")
def _(spark, t):
    # a page holds at most the blocks that fit on it
    pages = blocks(t("paragraphs")).filter("page_no < 3").groupBy("document_id", "page_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "content"))), lambda x: x["content"]), " ").alias("content"))
    return L.scanned_documents(pages)


@query("T22_valid_columns", f"""with {_BLOCKS}, {_COLUMNS}, {_KINDS}, held as (select k.document_id, k.page_no, column_no, kind, content from kinds k join columns_found c on c.document_id = k.document_id and c.page_no = k.page_no and (x0 + x1) / 2 >= from_x and (x0 + x1) / 2 < to_x)
select document_id, page_no, column_no, count(*) >= 3 and count(*) filter (kind = 'paragraph' and length(content) < 50 and content <> '' and right(content, 1) not in ('.', '?', '!', ':', ';')) < count(*) * 0.5 as valid from held group by document_id, page_no, column_no""")
def _(spark, t):
    kinds = L.block_kinds(blocks(t("paragraphs")))
    return L.valid_columns(kinds.join(L.in_columns(kinds, L.column_bounds(blocks(t("paragraphs")))), [*L.PAGE, "block_no"]))
