"""Further operators of the survey by their names: collapsed lists, cluster totals, exports, JSON pages and the tables
that adding and deleting leave, with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import paragraphs as P
from ..operators import similarity as S
from ..session import spread, table
from .textual import _GRAPH, _KEY

C, SQL, QUERIES = F.col, {}, {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(spark, lambda t: table(spark, sf_dir, t))
        if sql:
            SQL[name] = sql
        return build
    return add


def _clusters(t):
    return G.components(G.edges(t("similarity_results"), 0.8)).withColumnRenamed("component", "cluster_id")


@query("A6_J4_first_of_duplicates", "select min(id) as id, count(*) as n from paragraphs where content is not null group by content having count(*) > 1")
def _(spark, t):
    return t("paragraphs").filter("content is not null").groupBy("content").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "n")


@query("A13_J7_insert_pages", "select suite as name, count(item_id) as page_count, sum(length(text)) as characters from eval_items group by suite")
def _(spark, t):
    return t("eval_items").groupBy(C("suite").alias("name")).agg(F.count("item_id").alias("page_count"), F.sum(F.length("text")).alias("characters"))


@query("A19_cluster_totals", f"{_GRAPH} select count(distinct component) as clusters, count(*) as paragraphs, 0.8::double as mean_threshold from g join paragraphs p on p.id = g.id")
def _(spark, t):
    rows = G.clusters(_clusters(t), t("paragraphs"), 0.8)
    return rows.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("paragraphs"), F.lit(0)).alias("paragraphs"), F.round(F.avg("similarity_threshold"), 2).alias("mean_threshold"))


@query("F8_same_content_elsewhere", "select distinct p.id from paragraphs p where exists (select 1 from paragraphs q where q.content = p.content and q.id <> p.id)")
def _(spark, t):
    return P.raw_classes(t("paragraphs")).select("id")


@query("F12_J11_cross_document", f"""with k as (select id, document_id, {_KEY} as key from paragraphs where document_id is not null) select key, count(*) as paragraphs, count(distinct document_id) as documents from k where key <> '' group by key having count(distinct document_id) > 1""")
def _(spark, t):
    per = spread(t("paragraphs")).filter("document_id is not null").select("document_id", T.exact_key("content").alias("key")).filter("key <> ''").groupBy("key", "document_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("key").agg(F.sum("n").alias("paragraphs"), F.count(F.lit(1)).alias("documents")).filter("documents > 1")


@query("J13_U3_similar_without_exact", f"""with k as (select id, {_KEY} as key from paragraphs) select distinct least(paragraph1_id, paragraph2_id) as a, greatest(paragraph1_id, paragraph2_id) as b from similarity_results s join k x on x.id = paragraph1_id join k y on y.id = paragraph2_id where x.key <> y.key""")
def _(spark, t):
    keys = spread(t("paragraphs")).select("id", T.exact_key("content").alias("key"))
    pairs = t("similarity_results").select(F.least("paragraph1_id", "paragraph2_id").alias("a"), F.greatest("paragraph1_id", "paragraph2_id").alias("b")).distinct()
    side = lambda x: keys.select(C("id").alias(x), C("key").alias(f"key_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter("key_a <> key_b").select("a", "b")


@query("K21_P8_json_page", """select '{"page":2,"per_page":25,"total_items":' || (select count(*) from paragraphs) || ',"total_pages":' || (select (count(*) + 24) // 25 from paragraphs) || '}' as body""")
def _(spark, t):
    total = t("paragraphs").agg(F.count(F.lit(1)).alias("n"))
    return total.select(F.to_json(F.struct(F.lit(2).alias("page"), F.lit(25).alias("per_page"), C("n").alias("total_items"), F.floor((C("n") + 24) / 25).alias("total_pages"))).alias("body"))


@query("P6_P7_lists", "select document_id, string_agg(paragraph_type || ': ' || n, '; ' order by paragraph_type) as types from (select document_id, paragraph_type, count(*) as n from paragraphs group by all) group by document_id")
def _(spark, t):
    return P.type_histogram(t("paragraphs"), "document_id")


@query("S7_P12_first_cluster", f"{_GRAPH} select component as cluster_id, count(*) as members from g group by component order by component limit 1")
def _(spark, t):
    return _clusters(t).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members")).orderBy("cluster_id").limit(1)


@query("T20_encoded_lists", r"""select id, '[' || array_to_string(list_transform(list_sort(list_filter(regexp_extract_all(fonts_used, '["'']([^"'']*)["'']', 1), lambda x: x <> '')), lambda x: '"' || x || '"'), ',') || ']' as fonts from document_file_metadata where fonts_used is not null""")
def _(spark, t):
    return t("document_file_metadata").filter("fonts_used is not null").select("id", F.to_json(F.sort_array(F.filter(F.regexp_extract_all("fonts_used", F.lit("[\"']([^\"']*)[\"']"), F.lit(1)), lambda x: x != ""))).alias("fonts"))


@query("W2b_kept_headers", """select id, coalesce(nullif(trim(header_content), ''), case when lag(paragraph_type in ('header', 'heading')) over w and not paragraph_type in ('header', 'heading') then lag(content) over w end) as header
from paragraphs window w as (partition by document_id order by para_position, id)""")
def _(spark, t):
    rows = P.before_each(t("paragraphs"), ["document_id"], P._in_document(), ["paragraph_type", "content"])
    is_header = lambda c: F.coalesce(C(c).isin("header", "heading"), F.lit(False))
    return rows.select("id", F.coalesce(F.nullif(F.trim("header_content"), F.lit("")), F.when(is_header("previous_paragraph_type") & ~is_header("paragraph_type"), C("previous_content"))).alias("header"))


@query("U2_all_matches", f"""with k as (select id, {_KEY} as key, document_id from paragraphs where document_id is not null), e as (select id from k where key <> '' and key in (select key from k group by key having count(distinct document_id) > 1))
select id, 'exact' as kind from e union all select distinct p.id, 'similar' from similarity_results s join paragraphs p on p.id in (s.paragraph1_id, s.paragraph2_id) where s.similarity_type = 'similar'""")
def _(spark, t):
    exact = S.exact_classes(spread(t("paragraphs"))).select("id", F.lit("exact").alias("kind"))
    ends = t("similarity_results").filter("similarity_type = 'similar'").select(F.explode(F.array("paragraph1_id", "paragraph2_id")).alias("id")).distinct()
    return exact.unionByName(ends.join(spread(t("paragraphs")).select("id"), "id").select("id", F.lit("similar").alias("kind")))


@query("C3_differences")
def _(spark, t):
    return S.differences(_clusters(t).join(t("paragraphs").select("id", "content"), "id"))


@query("P9_clamped_pages", "select asked, least(greatest(asked, 10), 100) as per_page, least(greatest(asked, 10), 100) as held from (values (1), (10), (25), (100), (1000)) v(asked)")
def _(spark, t):
    rows = t("paragraphs").select("id")
    parts = [P.page(rows, [C("id")], 1, n).agg(F.lit(n).cast("long").alias("asked"), F.lit(P.page_size(n)).cast("long").alias("per_page"), F.count(F.lit(1)).alias("held")) for n in (1, 10, 25, 100, 1000)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("A21_W8_batch_summary", "select source, count(*) as total, count(page_count) as processed, count(*) - count(page_count) as failed, cast(coalesce(sum(page_count), 0) as bigint) as elapsed, round(avg(page_count), 4) as mean_seconds, round((count(*) - count(page_count)) * avg(page_count), 4) as remaining from documents d join document_file_metadata m on m.document_id = d.doc_id group by source")
def _(spark, t):
    """Files of each source as a batch in work, the page count as the seconds a file took and null for one still to do."""
    rows = t("document_file_metadata").join(t("documents").select(C("doc_id").alias("document_id"), "source"), "document_id")
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("page_count").alias("processed"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("elapsed"))
    return per.select("source", "total", "processed", (C("total") - C("processed")).alias("failed"), "elapsed", F.round(F.when(C("processed") > 0, C("elapsed") / C("processed")), 4).alias("mean_seconds"), F.round(T.remaining_seconds("total", "processed", "elapsed"), 4).alias("remaining"))


_COLLAPSE = rf"trim(regexp_replace(line, '{T.SPACE}+', ' ', 'g'))"


@query("T10_list_items", rf"""with l as (select id, unnest(string_split(content, chr(10))) as line, unnest(range(len(string_split(content, chr(10))))) as n from paragraphs where paragraph_type = 'list'),
m as (select id, n, {_COLLAPSE} as line, regexp_matches({_COLLAPSE}, '{T.LIST_ITEM}') as item from l), k as (select *, sum(item::int) over (partition by id order by n rows unbounded preceding) as place from m where line <> '')
select id, place, string_agg(line, ' ' order by n) as item from k where place > 0 group by id, place""")
def _(spark, t):
    return P.list_items(t("paragraphs").filter("paragraph_type = 'list'"))
