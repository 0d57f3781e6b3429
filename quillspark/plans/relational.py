"""Scans, filters, joins, aggregates, windows and resulting tables of mutations, by their survey names, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timestamps import with_instant
from ..operators import folds
from ..operators import paragraphs as P
from ..session import table

C, SQL, QUERIES = F.col, {}, {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, table) as a query, and the SQL that gives the same rows."""
    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(spark, lambda t: table(spark, sf_dir, t))
        if sql:
            SQL[name] = sql
        return build
    return add


def instants(t):
    """(doc_id, instant_us) of the upload dates."""
    zones = F.broadcast(t("source_zones").dropDuplicates(["source"]))
    return with_instant(t("documents").select("doc_id", "source", "upload_date").join(zones, "source", "left"), "upload_date", "time_zone", "slash_order").select("doc_id", "instant_us")


# --- scans ---------------------------------------------------------------------------------------------------------

# The order of upload dates is that of the instants they denote, of which the notation tells nothing; SQL reads only the
# notations with year, month and day first and leaves the others to the tests.

@query("S2_documents_newest")
def _(spark, t):
    """(doc_id, filename, file_type, file_path, instant_us, place): the newest first, undated last."""
    dated = t("documents").select("doc_id", "filename", "file_type", "file_path").join(instants(t), "doc_id")
    return P.numbered(dated, [C("instant_us").desc_nulls_last(), C("doc_id")], "place")


@query("S3_documents_page")
def _(spark, t):
    """(doc_id, filename, instant_us, total): the second page of the newest documents, with the number of all."""
    dated = t("documents").select("doc_id", "filename").join(instants(t), "doc_id")
    total = t("documents").agg(F.count(F.lit(1)).alias("total"))
    return P.side_by_side_all(P.page(dated, [C("instant_us").desc_nulls_last(), C("doc_id")], page=2, per_page=25), total)


@query("S4_paragraphs", """select p.id, p.content, p.document_id, p.paragraph_type, p.para_position, p.header_content, d.filename,
coalesce(g.tags, '') as tags from paragraphs p join documents d on p.document_id = d.doc_id left join (select paragraph_id,
string_agg(tag_name, ', ' order by tag_name) as tags from (select distinct paragraph_id, tag_id from paragraph_tags) x join tags using (tag_id) group by paragraph_id) g on g.paragraph_id = p.id""".replace("tags using (tag_id)", "tags on tags.id = x.tag_id"))
def _(spark, t):
    joined = P.with_documents(t("paragraphs"), t("documents"))
    return joined.join(P.tag_lists(t("paragraph_tags"), t("tags")), "id", "left").select(
        "id", "content", "document_id", "paragraph_type", "para_position", "header_content", "filename", F.coalesce("tags", F.lit("")).alias("tags"))


@query("S5_tags_with_counts", "select t.id, t.tag_name, t.color, count(distinct x.paragraph_id) as paragraphs from tags t left join paragraph_tags x on x.tag_id = t.id group by all")
def _(spark, t):
    return P.tag_usage(t("tags"), t("paragraph_tags"))


@query("S8_similar_paragraphs", """select s.id, a.id as paragraph1_id, b.id as paragraph2_id, a.content as content1, b.content as content2, d.filename as filename1, e.filename as filename2,
s.content_similarity_score, s.text_similarity_score, s.similarity_type from similarity_results s join paragraphs a on a.id = s.paragraph1_id join paragraphs b on b.id = s.paragraph2_id
join documents d on d.doc_id = a.document_id join documents e on e.doc_id = b.document_id where s.content_similarity_score >= 0.8""")
def _(spark, t):
    return P.similar_pairs(t("similarity_results"), t("paragraphs"), t("documents"), 0.8)


@query("S9_inserts", "select suite as name, count(*) as page_count from eval_items group by suite")
def _(spark, t):
    return t("eval_items").groupBy(C("suite").alias("name")).agg(F.count(F.lit(1)).alias("page_count"))


@query("S10_insert_pages", "select suite as name, row_number() over (partition by suite order by item_id) - 1 as page_number, text as content from eval_items")
def _(spark, t):
    return t("eval_items").select(C("suite").alias("name"), (F.row_number().over(Window.partitionBy("suite").orderBy("item_id")) - 1).cast("long").alias("page_number"), C("text").alias("content"))


@query("S11_file_metadata", r"""select id, document_id, file_size, list_aggregate(list_sort(list_filter(regexp_extract_all(fonts_used, '["'']([^"'']*)["'']', 1), lambda x: x <> '')), 'string_agg', '; ') as fonts,
list_aggregate(list_sort(list_filter(regexp_extract_all(styles_used, '["'']([^"'']*)["'']', 1), lambda x: x <> '')), 'string_agg', '; ') as styles from document_file_metadata""")
def _(spark, t):
    return t("document_file_metadata").select("id", "document_id", "file_size", P.listed("fonts_used").alias("fonts"), P.listed("styles_used").alias("styles"))


# --- filters and projections ------------------------------------------------------------------------------------------

@query("F1_document_filter", "select id, content from paragraphs where document_id = 1")
def _(spark, t):
    return P.search(t("paragraphs"), document_id=1).select("id", "content")


@query("F2_type_filter", "select id, document_id from paragraphs where paragraph_type = 'table'")
def _(spark, t):
    return P.search(t("paragraphs"), paragraph_type="table").select("id", "document_id")


@query("F3_has_tag", "select id, document_id from paragraphs where id in (select paragraph_id from paragraph_tags where tag_id = 3)")
def _(spark, t):
    return P.search(t("paragraphs"), tag_id=3, paragraph_tags=t("paragraph_tags")).select("id", "document_id")


@query("F4_min_length", "select id, length(content) as characters from paragraphs where length(content) >= 300")
def _(spark, t):
    return P.search(t("paragraphs"), min_length=300).select("id", F.length("content").cast("long").alias("characters"))


@query("F5_search", "select id from paragraphs where content ilike '%contract%shall%'")
def _(spark, t):
    return P.search(t("paragraphs"), text="contract%shall").select("id")


@query("F6_F15_threshold_and_type", "select id, content_similarity_score from similarity_results where content_similarity_score >= 0.8 and similarity_type = 'similar'")
def _(spark, t):
    return t("similarity_results").filter((C("content_similarity_score") >= 0.8) & (C("similarity_type") == "similar")).select("id", "content_similarity_score")


@query("F7_membership", "select id from paragraphs where id in (select paragraph1_id from similarity_results union select paragraph2_id from similarity_results)")
def _(spark, t):
    ends = t("similarity_results").select(F.explode(F.array("paragraph1_id", "paragraph2_id")).alias("id"))
    return t("paragraphs").select("id").join(ends, "id", "left_semi")


@query("F10_F11_F14_usable", "select id from paragraphs where content is not null and trim(content) <> '' and length(content) >= 10 and paragraph_type <> 'address'")
def _(spark, t):
    return t("paragraphs").filter((F.trim("content") != "") & (F.length("content") >= 10) & (C("paragraph_type") != "address")).select("id")


@query("F13_allowed_files", r"select doc_id, filename from documents where regexp_matches(filename, '(?i)\.(pdf|docx?)$')")
def _(spark, t):
    return t("documents").filter(P.allowed("filename")).select("doc_id", "filename")


@query("F16_contains", "select doc_id, filename from documents where contains(lower(filename), 'scan')")
def _(spark, t):
    return t("documents").filter(F.lower("filename").contains("scan")).select("doc_id", "filename")


@query("P1_P3_counts", rf"""select id, len(list_filter(regexp_split_to_array(content, '{T.SPACE}+'), lambda x: x <> '')) as words, length(content) as characters,
len(regexp_extract_all(content, '[.!?]+')) as sentences from paragraphs""")
def _(spark, t):
    return t("paragraphs").select("id", T.word_count("content").cast("long").alias("words"), F.length("content").cast("long").alias("characters"), T.sentence_count("content").cast("long").alias("sentences"))


@query("P4_P10_score_percent", "select id, round(content_similarity_score * 100, 2) as content_percent, coalesce(cast(round(text_similarity_score * 100, 2) as varchar), 'N/A') as text_percent from similarity_results")
def _(spark, t):
    return t("similarity_results").select("id", F.round(C("content_similarity_score") * 100, 2).alias("content_percent"), F.coalesce(F.round(C("text_similarity_score") * 100, 2).cast("string"), F.lit("N/A")).alias("text_percent"))


@query("P5_differences", rf"""select s.id, abs(length(a.content) - length(b.content)) as character_difference,
abs(len(list_filter(regexp_split_to_array(a.content, '{T.SPACE}+'), lambda x: x <> '')) - len(list_filter(regexp_split_to_array(b.content, '{T.SPACE}+'), lambda x: x <> ''))) as word_difference
from similarity_results s join paragraphs a on a.id = s.paragraph1_id join paragraphs b on b.id = s.paragraph2_id where a.content <> '' and b.content <> ''""")
def _(spark, t):
    x = P.pair_contents(t("similarity_results"), t("paragraphs")).filter("content1 <> '' and content2 <> ''")
    return x.select("id", F.abs(F.length("content1") - F.length("content2")).cast("long").alias("character_difference"), F.abs(T.word_count("content1") - T.word_count("content2")).cast("long").alias("word_difference"))


@query("P11_document_links", "select filename, max(doc_id) as doc_id from documents group by filename")
def _(spark, t):
    return t("documents").groupBy("filename").agg(F.max("doc_id").alias("doc_id"))


@query("P13_tag_colours", "select id, tag_name, color in ('#ffffff', '#f8f9fa', '#ffc107', '#fff') as is_light from tags")
def _(spark, t):
    return t("tags").select("id", "tag_name", C("color").isin("#ffffff", "#f8f9fa", "#ffc107", "#fff").alias("is_light"))


# --- joins ------------------------------------------------------------------------------------------------------------

@query("J3_occurrences", "select p.id, coalesce(c.n, 1) as occurrences from paragraphs p left join (select content, count(id) as n from paragraphs group by content) c on c.content = p.content")
def _(spark, t):
    return P.with_occurrences(t("paragraphs")).select("id", "occurrences")


@query("J8_connections", """select document_id, count(*) as similarity_connections from (select distinct s.id, p.document_id from similarity_results s join paragraphs p on p.id in (s.paragraph1_id, s.paragraph2_id)) group by document_id""")
def _(spark, t):
    return P.connections(t("similarity_results"), t("paragraphs"))


@query("J9_paragraph_tags", "select distinct p.id, t.tag_name from paragraphs p join paragraph_tags x on x.paragraph_id = p.id join tags t on t.id = x.tag_id")
def _(spark, t):
    return t("paragraph_tags").distinct().join(F.broadcast(t("tags").select(C("id").alias("tag_id"), "tag_name")), "tag_id").select(C("paragraph_id").alias("id"), "tag_name").join(t("paragraphs").select("id"), "id")


@query("J10_D18_duplicates", """select id, min(id) over (partition by content) as class_id, count(*) over (partition by content) - 1 as duplicates from paragraphs
where content in (select content from paragraphs group by content having count(*) > 1)""")
def _(spark, t):
    return P.raw_classes(t("paragraphs"))


@query("J16_document_metadata", "select d.doc_id, d.filename, m.file_size, m.page_count, m.author from documents d left join (select * from document_file_metadata qualify row_number() over (partition by document_id order by id desc) = 1) m on m.document_id = d.doc_id")
def _(spark, t):
    last = P.first_of(t("document_file_metadata"), ["document_id"], [C("id").desc()]).select(C("document_id").alias("doc_id"), "file_size", "page_count", "author")
    return t("documents").select("doc_id", "filename").join(last, "doc_id", "left")


# --- aggregates --------------------------------------------------------------------------------------------------------

@query("A1_A4_document_statistics", """select (select count(*) from documents) as total_documents, count(id) as total_paragraphs, count(distinct content) as unique_paragraphs,
(select count(*) from (select content from paragraphs where content is not null group by content having count(id) > 1)) as duplicate_paragraphs from paragraphs""")
def _(spark, t):
    return P.statistics(t("documents"), t("paragraphs"))


@query("A5_A10_references", """select c.class_id, p.id, p.document_id, d.filename, c.n as occurrences, c.n > 1 as appears_in_multiple from paragraphs p join documents d on d.doc_id = p.document_id
join (select content, min(p.id) as class_id, count(*) as n from paragraphs p join documents d on d.doc_id = p.document_id where content is not null group by content) c on c.content = p.content""")
def _(spark, t):
    return P.references(t("paragraphs"), t("documents"))


@query("A7_duplicate_groups", """select c.class_id, c.n as copies, p.id, p.document_id, d.filename from paragraphs p join documents d on d.doc_id = p.document_id
join (select content, min(p.id) as class_id, count(*) as n from paragraphs p join documents d on d.doc_id = p.document_id where content is not null group by content having count(*) > 1) c on c.content = p.content""")
def _(spark, t):
    return P.duplicate_groups(t("paragraphs"), t("documents"))


@query("A9_collapsed_references", """with k as (select p.id, p.content, p.document_id, d.filename from paragraphs p join documents d on d.doc_id = p.document_id where content is not null), c as (select content, min(id) as id, count(*) as n from k group by content)
select c.id, c.n > 1 as appears_in_multiple, k.id as reference_id, k.filename from c join k on k.content = c.content""")
def _(spark, t):
    """Each content once as its smallest id, with the file of every paragraph that holds it, one row per reference."""
    return P.references(t("paragraphs"), t("documents")).select(C("class_id").alias("id"), "appears_in_multiple", C("id").alias("reference_id"), "filename")


@query("A8_collapsed", """select id, document_id from (select *, row_number() over (partition by content order by id) as n from paragraphs) where n = 1 and document_id = 1""")
def _(spark, t):
    return P.collapsed(t("paragraphs")).filter("document_id = 1").select("id", "document_id")


@query("A8_collapsed_within", "select min(id) as id from paragraphs where paragraph_type = 'boilerplate' group by content")
def _(spark, t):
    return P.collapsed(P.search(t("paragraphs"), paragraph_type="boilerplate")).select("id")


@query("A12_most_used_tag", """with u as (select t.id, t.tag_name, count(distinct x.paragraph_id) as n from tags t left join paragraph_tags x on x.tag_id = t.id group by all)
select cast(sum(n) as bigint) as total_usage, coalesce(first(tag_name order by n desc, id), 'None') as most_used from u""")
def _(spark, t):
    used = P.tag_usage(t("tags"), t("paragraph_tags"))
    return used.agg(F.coalesce(F.sum("paragraphs"), F.lit(0)).alias("total_usage"), F.coalesce(F.max_by("tag_name", F.struct("paragraphs", -C("id"))), F.lit("None")).alias("most_used"))


@query("A15_document_report", rf"""with s as (select document_id, count(*) as n from (select distinct s.id, p.document_id from similarity_results s join paragraphs p on p.id in (s.paragraph1_id, s.paragraph2_id)) group by document_id),
k as (select document_id, paragraph_type, count(*) as n from paragraphs group by all), h as (select document_id, string_agg(paragraph_type || ': ' || n, '; ' order by paragraph_type) as types from k group by document_id)
select d.doc_id, d.filename, count(p.id) as paragraphs, cast(coalesce(sum(len(list_filter(regexp_split_to_array(p.content, '{T.SPACE}+'), lambda x: x <> ''))), 0) as bigint) as words,
cast(coalesce(sum(length(p.content)), 0) as bigint) as characters, coalesce(any_value(h.types), '') as types, coalesce(any_value(s.n), 0) as connections
from documents d left join paragraphs p on p.document_id = d.doc_id left join h on h.document_id = d.doc_id left join s on s.document_id = d.doc_id group by d.doc_id, d.filename""")
def _(spark, t):
    return P.document_report(t("documents"), t("paragraphs"), t("similarity_results"))


@query("A16_tag_statistics", """select t.id, t.tag_name, count(distinct p.id) as paragraphs, count(distinct p.document_id) as documents from tags t left join paragraph_tags x on x.tag_id = t.id left join paragraphs p on p.id = x.paragraph_id group by all""")
def _(spark, t):
    return P.tag_report(t("tags"), t("paragraph_tags"), t("paragraphs"))


@query("A18_summary", """select (select count(*) from documents) as documents, (select count(*) from paragraphs) as paragraphs, (select count(*) from tags) as tags, count(*) as results,
count(*) filter (similarity_type = 'exact') as exact, count(*) filter (similarity_type = 'similar') as similar, round(avg(content_similarity_score), 6) as mean_content, round(avg(text_similarity_score), 6) as mean_text from similarity_results""")
def _(spark, t):
    return P.summary(t("documents"), t("paragraphs"), t("tags"), t("similarity_results"))


@query("A25_by_type", "select paragraph_type, count(*) as n, count(distinct content) as contents from paragraphs group by paragraph_type")
def _(spark, t):
    return t("paragraphs").groupBy("paragraph_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("content").alias("contents"))


@query("A24_documents_of_contents", "select content, count(distinct document_id) as documents from paragraphs where content is not null group by content having count(distinct document_id) > 1")
def _(spark, t):
    return t("paragraphs").filter("content is not null").groupBy("content").agg(F.countDistinct("document_id").alias("documents")).filter("documents > 1")


# --- order and windows ---------------------------------------------------------------------------------------------------

@query("O1_sort_length_page", "select id, length(content) as characters from paragraphs order by length(content) desc, id limit 25 offset 50")
def _(spark, t):
    return P.page(t("paragraphs").select("id", F.length("content").cast("long").alias("characters")), [C("characters").desc(), C("id")], page=3, per_page=25)


@query("O2_sort_occurrences_page", "select p.id, c.n as occurrences from paragraphs p join (select content, count(*) as n from paragraphs group by content) c using (content) order by n desc, p.id limit 25")
def _(spark, t):
    return P.page(P.with_occurrences(t("paragraphs")).select("id", "occurrences"), [C("occurrences").desc(), C("id")], page=1, per_page=25)


@query("O4_composite_order", "select id, row_number() over (partition by document_id order by para_position, id) as place from paragraphs")
def _(spark, t):
    return P.positions(t("paragraphs").select("id", "document_id", "para_position")).select("id", (C("sequence") + 1).alias("place"))


@query("W1_positions", "select id, row_number() over (partition by document_id order by para_position, id) - 1 as sequence from paragraphs")
def _(spark, t):
    return P.positions(t("paragraphs").select("id", "document_id", "para_position")).select("id", "sequence")


@query("W2_headers", """select id, case when lag(paragraph_type in ('header', 'heading')) over w and not paragraph_type in ('header', 'heading') then lag(content) over w end as header
from paragraphs window w as (partition by document_id, column_no order by para_position, id)""")
def _(spark, t):
    return P.headed(t("paragraphs")).select("id", "header")


@query("W3_runs", """with m as (select *, case when lag(paragraph_type) over w = paragraph_type and paragraph_type in ('list', 'table') then 0 else 1 end as new from paragraphs window w as (partition by document_id order by para_position, id)),
r as (select *, sum(new) over (partition by document_id order by para_position, id) as run from m)
select min_by(id, (para_position, id)) as id, string_agg(content, chr(10) order by para_position, id) as content, count(*) as merged from r group by document_id, run""".replace("min_by(id, (para_position, id))", "first(id order by para_position, id)"))
def _(spark, t):
    return folds.merged_runs(t("paragraphs")).select("id", "content", "merged")


# --- set operations -------------------------------------------------------------------------------------------------------

@query("U1_U4_end_sets", """select count(*) filter (a and b) as in_both, count(*) filter (a and not b) as first_only, count(*) filter (b and not a) as second_only, count(*) as in_any from (
select id, bool_or(a) as a, bool_or(b) as b from (select paragraph1_id as id, true as a, false as b from similarity_results union all select paragraph2_id, false, true from similarity_results) group by id)""")
def _(spark, t):
    ends = t("similarity_results").select(F.explode(F.array(F.struct(C("paragraph1_id").alias("id"), F.lit(True).alias("a"), F.lit(False).alias("b")), F.struct(C("paragraph2_id").alias("id"), F.lit(False).alias("a"), F.lit(True).alias("b")))).alias("e")).select("e.*")
    sides = ends.groupBy("id").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return sides.agg(F.count_if(C("a") & C("b")).alias("in_both"), F.count_if(C("a") & ~C("b")).alias("first_only"), F.count_if(C("b") & ~C("a")).alias("second_only"), F.count(F.lit(1)).alias("in_any"))


# --- mutations: the tables that result ---------------------------------------------------------------------------------------

@query("K9_tag_all_duplicates", """select distinct paragraph_id, tag_id from paragraph_tags union select q.id, x.tag_id from paragraph_tags x join paragraphs p on p.id = x.paragraph_id join paragraphs q on q.content = p.content""")
def _(spark, t):
    return P.tagged_duplicates(t("paragraph_tags"), t("paragraphs"))


@query("K10_untag_duplicates", """select distinct paragraph_id, tag_id from paragraph_tags x where not exists (select 1 from paragraphs p join paragraphs q on p.content = q.content where q.id = x.paragraph_id and p.id = (select min(paragraph_id) from paragraph_tags) and x.tag_id = (select min(tag_id) from paragraph_tags where paragraph_id = (select min(paragraph_id) from paragraph_tags)))""")
def _(spark, t):
    tags, first = t("paragraph_tags"), t("paragraph_tags").agg(F.min_by(F.struct("paragraph_id", "tag_id"), F.struct("paragraph_id", "tag_id")).alias("x")).select("x.*")
    return P.untagged_duplicates(tags, t("paragraphs"), first)


