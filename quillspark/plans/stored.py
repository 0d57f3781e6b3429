"""Changes to the tables by their survey names: each query makes the change in a store and reads the tables back, beside
SQL that gives the rows it should leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import paragraphs as P
from ..operators.library import Library
from ..session import folder, table
from .textual import _GRAPH

C, SQL, QUERIES = F.col, {}, {}
NOW = "2026-01-01T00:00:00"


def query(name: str, sql: str | None = None):
    """Register a function of (spark, library) as a query, and the SQL that gives the same rows."""
    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(spark, library(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return build
    return add


_INSERTS = """inserts as (select row_number() over (order by suite) as id, suite as name from (select distinct suite from eval_items where suite is not null)),
insert_pages as (select item_id as id, text as content, i.id as insert_id, row_number() over (partition by suite order by item_id) - 1 as page_number from eval_items e join inserts i on i.name = e.suite)"""


def library(spark, sf_dir) -> Library:
    """The tables, with inserts made of the evaluation items and no clusters yet."""
    base = {n: table(spark, sf_dir, n) for n in ("documents", "paragraphs", "document_file_metadata", "similarity_results", "tags", "paragraph_tags")}
    items = table(spark, sf_dir, "eval_items").filter("suite is not null")
    inserts = P.numbered(items.select(C("suite").alias("name")).distinct(), [C("name")], "id")
    base["inserts"] = inserts.select("id", "name", *[F.lit(None).cast("string").alias(c) for c in ("filename", "file_type", "file_path", "upload_date")])
    base["insert_pages"] = P.positions(items.select(C("item_id").alias("id"), "text", C("suite").alias("document_id"), C("item_id").alias("para_position"))).join(
        F.broadcast(inserts.withColumnRenamed("id", "insert_id")), C("document_id") == C("name")).select("id", C("text").alias("content"), "insert_id", C("sequence").alias("page_number"))
    base["clusters"] = spark.createDataFrame([], "id long, name string, description string, creation_date string, similarity_threshold double, similarity_type string")
    base["cluster_paragraphs"] = spark.createDataFrame([], "cluster_id long, paragraph_id long")
    return Library(spark, folder(spark, "library"), base)


@query("K1_added_document", f"select doc_id, filename, file_type, upload_date from documents union all select (select max(doc_id) from documents) + 1, 'new.docx', 'docx', '{NOW}'")
def _(spark, held):
    added = held.add_document("new.docx", "docx", "/in/new.docx", NOW)
    assert added > 0 and held.add_document(None, "docx", "", NOW) == -1
    return held.table("documents").select("doc_id", "filename", "file_type", "upload_date")


@query("K2_added_paragraphs", "select id, content, document_id, para_position from paragraphs union all select (select max(id) from paragraphs) + n, c, 1, n from (values (1, 'first added'), (2, 'second added'), (3, 'third added')) v(n, c)")
def _(spark, held):
    held.add_paragraphs(spark.createDataFrame([(c, 1, "normal", n) for n, c in ((3, "third added"), (1, "first added"), (2, "second added"))], "content string, document_id long, paragraph_type string, para_position int"))
    return held.table("paragraphs").select("id", "content", "document_id", "para_position")


_BEST = "select least(paragraph1_id, paragraph2_id) as p1, greatest(paragraph1_id, paragraph2_id) as p2, max(content_similarity_score) as score from similarity_results where paragraph1_id <> paragraph2_id group by 1, 2"


@query("K3_replaced_results", f"select row_number() over (order by p1, p2) as id, p1 as paragraph1_id, p2 as paragraph2_id, score as content_similarity_score from ({_BEST})")
def _(spark, held):
    new = P.replaced_results(held.table("similarity_results")).withColumns({"text_similarity_score": F.lit(None).cast("double"), "similarity_type": F.lit("similar")})
    held.replace_results(new)
    # no results replace nothing
    assert held.replace_results(new.limit(0)) == 0
    return held.table("similarity_results").select("id", "paragraph1_id", "paragraph2_id", "content_similarity_score")


@query("K4_upserted_metadata", """with l as (select max(id) as id from document_file_metadata where document_id = 1) select m.id, m.document_id, case when m.id = l.id then 'New Author' else author end as author, case when m.id = l.id then 77 else page_count end as page_count, m.file_size
from document_file_metadata m, l union all select (select max(id) from document_file_metadata) + 1, (select max(doc_id) from documents) + 5, 'Other', null, 12 from (select 1) x""")
def _(spark, held):
    held.upsert_metadata(1, author="New Author", page_count=77, mood="none of the columns")
    new = held.table("documents").agg(F.max("doc_id")).first()[0] + 5
    held.upsert_metadata(new, author="Other", file_size=12)
    return held.table("document_file_metadata").select("id", "document_id", "author", "page_count", "file_size")


@query("K5_deleted_metadata", "select id, document_id, file_size from document_file_metadata where document_id is distinct from 1")
def _(spark, held):
    held.delete_metadata(1)
    return held.table("document_file_metadata").select("id", "document_id", "file_size")


_DEFAULTS = "(values (1, 'Header', '#007bff'), (2, 'Footer', '#6c757d'), (3, 'Disclaimer', '#dc3545'), (4, 'Important', '#ffc107'), (5, 'Common', '#28a745')) v(k, n, c)"


@query("K6_K7_added_tags", f"""with d as (select row_number() over (order by k) as k, n, c from {_DEFAULTS} where n not in (select tag_name from tags)) select id, tag_name, color from tags union all select (select max(id) from tags) + k, n, c from d
union all select (select max(id) from tags) + (select count(*) from d) + 1, 'To be checked', '#123456'""")
def _(spark, held):
    held.add_default_tags()
    added = held.add_tag("To be checked", "#123456")
    assert added > 0 and held.add_tag("To be checked", "#654321") == -1
    return held.table("tags")


@query("K8_deleted_tag", "select 'use' as kind, paragraph_id as a, tag_id as b from (select distinct * from paragraph_tags) where tag_id <> 3 union all select 'tag', id, id from tags where id <> 3")
def _(spark, held):
    held.delete_tag(3)
    assert not held.delete_tag(3)
    return held.table("paragraph_tags").select(F.lit("use").alias("kind"), C("paragraph_id").alias("a"), C("tag_id").alias("b")).unionByName(held.table("tags").select(F.lit("tag").alias("kind"), C("id").alias("a"), C("id").alias("b")))


@query("C13_batch_tagged", "select distinct paragraph_id, tag_id from paragraph_tags union select q.id, 5 from paragraphs p join paragraphs q on q.content = p.content or q.id = p.id where p.id % 20 = 0 and p.paragraph_type = 'boilerplate'")
def _(spark, held):
    chosen = held.table("paragraphs").filter("id % 20 = 0 and paragraph_type = 'boilerplate'").select("id")
    return held.tag(chosen, 5)


@query("K10_batch_untagged", "select distinct paragraph_id, tag_id from paragraph_tags where not (tag_id = 2 and paragraph_id in (select q.id from paragraphs p join paragraphs q on q.content = p.content or q.id = p.id where p.id % 20 = 0))")
def _(spark, held):
    return held.untag(held.table("paragraphs").filter("id % 20 = 0").select("id"), 2)


def _made(held: Library) -> Library:
    """Components of linked paragraphs as clusters."""
    labels = G.components(G.edges(held.table("similarity_results"), 0.8)).withColumnRenamed("component", "cluster_id")
    named = G.clusters(labels, held.table("paragraphs"), 0.8).select("cluster_id", "name", "description", "similarity_threshold", F.lit("content").alias("similarity_type"))
    members = labels.select("cluster_id", C("id").alias("paragraph_id")).join(named.select("cluster_id"), "cluster_id", "left_semi")
    held.create_clusters(members, named, NOW)
    held.add_members(members.limit(0))
    return held


_NUMBERS = f"{_GRAPH}, c as (select component, row_number() over (order by component) as n from (select distinct component from g join paragraphs p on p.id = g.id))"


@query("K11_K12_created_clusters", f"{_NUMBERS} select c.n as cluster_id, g.id as paragraph_id from g join paragraphs p on p.id = g.id join c on c.component = g.component")
def _(spark, held):
    return _made(held).table("cluster_paragraphs").select("cluster_id", "paragraph_id")


@query("K11_cluster_rows", f"""{_NUMBERS} select c.n as id, 'Cluster ' || g.component || ': ' || substring(first(p.content order by p.id), 1, 50) || '...' as name, '{NOW}' as creation_date, 0.8::double as similarity_threshold
from g join paragraphs p on p.id = g.id join c on c.component = g.component group by c.n, g.component""")
def _(spark, held):
    return _made(held).table("clusters").select("id", "name", "creation_date", "similarity_threshold")


@query("K13_deleted_cluster", f"{_NUMBERS} select 'member' as kind, c.n as cluster_id, g.id as paragraph_id from g join paragraphs p on p.id = g.id join c on c.component = g.component where c.n <> 1 union all select 'cluster', n, null from c where n <> 1")
def _(spark, held):
    _made(held).delete_cluster(1)
    return held.table("cluster_paragraphs").select(F.lit("member").alias("kind"), "cluster_id", "paragraph_id").unionByName(held.table("clusters").select(F.lit("cluster").alias("kind"), C("id").alias("cluster_id"), F.lit(None).cast("long").alias("paragraph_id")))


@query("K13_cleared_clusters", f"{_NUMBERS} select count(*) as cleared, 0 as clusters, 0 as members from c")
def _(spark, held):
    cleared = _made(held).clear_clusters()
    sizes = P.side_by_side(held.table("clusters").agg(F.count(F.lit(1)).alias("clusters")), held.table("cluster_paragraphs").agg(F.count(F.lit(1)).alias("members")))
    return sizes.select(F.lit(cleared).cast("long").alias("cleared"), "clusters", "members")


@query("K14_deleted_document", """select 'paragraph' as kind, id from paragraphs where document_id <> 1 union all select 'document', doc_id from documents where doc_id <> 1 union all select 'metadata', id from document_file_metadata where document_id <> 1
union all select 'result', id from similarity_results where paragraph1_id not in (select id from paragraphs where document_id = 1) and paragraph2_id not in (select id from paragraphs where document_id = 1)""")
def _(spark, held):
    held.delete_document(1)
    part = lambda kind, name, key="id": held.table(name).select(F.lit(kind).alias("kind"), C(key).alias("id"))
    return part("paragraph", "paragraphs").unionByName(part("document", "documents", "doc_id")).unionByName(part("metadata", "document_file_metadata")).unionByName(part("result", "similarity_results"))


@query("K15_cleared", f"""with {_INSERTS} select 'documents' as name, count(*) as had, 0 as left_over from documents union all select 'paragraphs', count(*), 0 from paragraphs union all select 'document_file_metadata', count(*), 0 from document_file_metadata
union all select 'similarity_results', count(*), 0 from similarity_results union all select 'paragraph_tags', count(*), 0 from paragraph_tags union all select 'inserts', count(*), 0 from inserts union all select 'insert_pages', count(*), 0 from insert_pages
union all select 'clusters', 0, 0 union all select 'cluster_paragraphs', 0, 0 union all select 'tags', count(*), count(*) from tags""")
def _(spark, held):
    had = held.clear() | {"tags": held.table("tags").count()}
    left = P.sizes({name: held.table(name) for name in held.base})
    return left.join(F.broadcast(spark.createDataFrame(list(had.items()), "name string, had long")), "name").select("name", "had", C("n").alias("left_over"))


@query("K16_cleared_results", "select count(*) as cleared, 0 as left_over from similarity_results")
def _(spark, held):
    cleared = held.clear_results()
    return held.table("similarity_results").agg(F.lit(cleared).cast("long").alias("cleared"), F.count(F.lit(1)).alias("left_over"))


@query("K17_added_insert", f"""with {_INSERTS} select id, insert_id, page_number, content from insert_pages union all select (select max(id) from insert_pages) + 1 + n, (select max(id) from inserts) + 1, n, c from (values (0, 'first page'), (1, 'second page')) v(n, c)""")
def _(spark, held):
    insert = held.add_insert("Added", "added.docx", "docx", "/in/added.docx", NOW)
    held.add_insert_pages(insert, spark.createDataFrame([(1, "second page"), (0, "first page")], "page_number long, content string"))
    return held.table("insert_pages").select("id", "insert_id", "page_number", "content")


@query("K18_deleted_insert", f"with {_INSERTS} select id, insert_id, page_number from insert_pages where insert_id <> 1 and id <> (select max(id) from insert_pages where insert_id <> 1)")
def _(spark, held):
    held.delete_insert(1)
    held.delete_insert_page(held.table("insert_pages").agg(F.max("id")).first()[0])
    return held.table("insert_pages").select("id", "insert_id", "page_number")


# --- exports: each sheet as a frame -----------------------------------------------------------------------------------

_TAGS = "tagged as (select paragraph_id, string_agg(tag_name, ', ' order by tag_name) as tags from (select distinct paragraph_id, tag_id from paragraph_tags) x join tags on tags.id = x.tag_id group by paragraph_id)"
_WORDS = lambda x: rf"len(list_filter(regexp_split_to_array({x}, '{T.SPACE}+'), lambda x: x <> ''))"


@query("K19_paragraph_sheet", f"with {_TAGS} select p.id, p.content, p.paragraph_type, p.header_content, d.filename, d.upload_date, g.tags from paragraphs p join documents d on d.doc_id = p.document_id left join tagged g on g.paragraph_id = p.id")
def _(spark, held):
    rows = held.table("paragraphs").join(held.table("documents").select(C("doc_id").alias("document_id"), "filename", "upload_date"), "document_id")
    return rows.join(P.tag_lists(held.table("paragraph_tags"), held.table("tags")), "id", "left").select("id", "content", "paragraph_type", "header_content", "filename", "upload_date", "tags")


@query("K19_similarity_sheet", """select s.id, s.content_similarity_score, s.text_similarity_score, s.similarity_type, a.content as paragraph1_content, d.filename as document1, b.content as paragraph2_content, coalesce(e.filename, 'Unknown') as document2
from similarity_results s join paragraphs a on a.id = s.paragraph1_id join documents d on d.doc_id = a.document_id join paragraphs b on b.id = s.paragraph2_id left join documents e on e.doc_id = b.document_id where s.content_similarity_score >= 0.8""")
def _(spark, held):
    names = lambda k: held.table("documents").select(C("doc_id").alias(f"document{k}_id"), C("filename").alias(f"document{k}"))
    pairs = P.pair_contents(held.table("similarity_results").filter("content_similarity_score >= 0.8"), held.table("paragraphs")).join(names(1), "document1_id").join(names(2), "document2_id", "left")
    return pairs.select("id", "content_similarity_score", "text_similarity_score", "similarity_type", C("content1").alias("paragraph1_content"), "document1", C("content2").alias("paragraph2_content"), F.coalesce("document2", F.lit("Unknown")).alias("document2"))


@query("K20_paragraph_sheet", f"""with {_TAGS} select p.id, d.filename, d.file_type, d.upload_date, p.para_position, p.paragraph_type, coalesce({_WORDS('p.content')}, 0) as words, coalesce(length(p.content), 0) as characters,
coalesce(p.header_content, '') as header_content, p.content, coalesce(g.tags, '') as tags from paragraphs p join documents d on d.doc_id = p.document_id left join tagged g on g.paragraph_id = p.id""")
def _(spark, held):
    rows = held.table("paragraphs").join(held.table("documents").select(C("doc_id").alias("document_id"), "filename", "file_type", "upload_date"), "document_id")
    return rows.join(P.tag_lists(held.table("paragraph_tags"), held.table("tags")), "id", "left").select(
        "id", "filename", "file_type", "upload_date", "para_position", "paragraph_type", F.coalesce(T.word_count("content"), F.lit(0)).cast("long").alias("words"), F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("characters"),
        F.coalesce("header_content", F.lit("")).alias("header_content"), "content", F.coalesce("tags", F.lit("")).alias("tags"))


@query("K20_similarity_sheet", f"""select s.id, s.paragraph1_id, s.paragraph2_id, round(s.content_similarity_score * 100, 2) as content_percent, round(s.text_similarity_score * 100, 2) as text_percent, s.similarity_type, d.filename as document1, e.filename as document2,
abs(coalesce({_WORDS('a.content')}, 0) - coalesce({_WORDS('b.content')}, 0)) as word_difference, case when a.content <> '' and b.content <> '' then abs(length(a.content) - length(b.content)) else 0 end as character_difference, a.paragraph_type as type1, b.paragraph_type as type2
from similarity_results s join paragraphs a on a.id = s.paragraph1_id join documents d on d.doc_id = a.document_id join paragraphs b on b.id = s.paragraph2_id join documents e on e.doc_id = b.document_id""")
def _(spark, held):
    docs, paragraphs = held.table("documents"), held.table("paragraphs")
    side = lambda k: paragraphs.select(C("id").alias(f"paragraph{k}_id"), C("content").alias(f"content{k}"), C("document_id").alias(f"document{k}_id"), C("paragraph_type").alias(f"type{k}")).join(
        docs.select(C("doc_id").alias(f"document{k}_id"), C("filename").alias(f"document{k}")), f"document{k}_id")
    words = lambda k: F.coalesce(T.word_count(f"content{k}"), F.lit(0))
    both = (C("content1") != "") & (C("content2") != "")
    return held.table("similarity_results").join(side(1), "paragraph1_id").join(side(2), "paragraph2_id").select(
        "id", "paragraph1_id", "paragraph2_id", F.round(C("content_similarity_score") * 100, 2).alias("content_percent"), F.round(C("text_similarity_score") * 100, 2).alias("text_percent"), "similarity_type", "document1", "document2",
        F.abs(words(1) - words(2)).cast("long").alias("word_difference"), F.when(both, F.abs(F.length("content1") - F.length("content2"))).otherwise(0).cast("long").alias("character_difference"), "type1", "type2")


@query("K20_document_sheet", f"""with s as (select document_id, count(*) as n from (select distinct s.id, p.document_id from similarity_results s join paragraphs p on p.id in (s.paragraph1_id, s.paragraph2_id)) group by document_id),
k as (select document_id, paragraph_type, count(*) as n from paragraphs group by all), h as (select document_id, string_agg(paragraph_type || ': ' || n, '; ' order by paragraph_type) as types from k group by document_id)
select d.doc_id, d.filename, d.file_type, d.upload_date, count(p.id) as paragraphs, cast(coalesce(sum({_WORDS('p.content')}), 0) as bigint) as words, cast(coalesce(sum(length(p.content)), 0) as bigint) as characters, coalesce(any_value(h.types), '') as types,
coalesce(any_value(s.n), 0) as connections from documents d left join paragraphs p on p.document_id = d.doc_id left join h on h.document_id = d.doc_id left join s on s.document_id = d.doc_id group by d.doc_id, d.filename, d.file_type, d.upload_date""")
def _(spark, held):
    docs = held.table("documents")
    report = P.document_report(docs, held.table("paragraphs"), held.table("similarity_results"))
    return report.join(docs.select("doc_id", "file_type", "upload_date"), "doc_id").select("doc_id", "filename", "file_type", "upload_date", "paragraphs", "words", "characters", "types", "connections")


@query("K20_tag_sheet", "select t.id, t.tag_name, t.color, count(distinct p.id) as paragraphs, count(distinct p.document_id) as documents from tags t left join paragraph_tags x on x.tag_id = t.id left join paragraphs p on p.id = x.paragraph_id group by all")
def _(spark, held):
    return P.tag_report(held.table("tags"), held.table("paragraph_tags"), held.table("paragraphs")).join(held.table("tags").select("id", "color"), "id").select("id", "tag_name", "color", "paragraphs", "documents")


@query("K20_cluster_sheet", f"""{_NUMBERS}, m as (select c.n as id, p.document_id, p.paragraph_type from g join paragraphs p on p.id = g.id join c on c.component = g.component),
k as (select id, string_agg(paragraph_type || ': ' || n, '; ' order by paragraph_type) as types from (select id, paragraph_type, count(*) as n from m group by all) group by id),
f as (select id, string_agg(filename, ', ' order by filename, doc_id) as documents from (select distinct id, document_id from m) x join documents d on d.doc_id = x.document_id group by id)
select m.id, count(*) as paragraphs, count(distinct document_id) as document_count, any_value(f.documents) as documents, any_value(k.types) as types, 0.8::double as similarity_threshold, 'content' as similarity_type
from m join k on k.id = m.id left join f on f.id = m.id group by m.id""")
def _(spark, held):
    _made(held)
    rows = held.table("cluster_paragraphs").select(C("cluster_id").alias("id"), "paragraph_id").join(held.table("paragraphs").select(C("id").alias("paragraph_id"), "document_id", "paragraph_type"), "paragraph_id")
    per = rows.groupBy("id", "document_id").agg(F.count(F.lit(1)).alias("n"))
    # a list has as many names as the cluster has documents, as the sheet demands
    names = per.join(held.table("documents").select(C("doc_id").alias("document_id"), "filename"), "document_id").groupBy("id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("filename", "document_id"))), lambda x: x["filename"]), ", ").alias("documents"))
    counts = per.groupBy("id").agg(F.sum("n").alias("paragraphs"), F.count("document_id").alias("document_count"))
    return counts.join(names, "id", "left").join(P.type_histogram(rows, "id"), "id").join(held.table("clusters").select("id", "similarity_threshold", "similarity_type"), "id").select(
        "id", "paragraphs", "document_count", "documents", "types", "similarity_threshold", "similarity_type")


@query("K20_summary_sheet", f"""{_NUMBERS}, res as (select count(*) as n, count(*) filter (similarity_type = 'exact') as e, count(*) filter (similarity_type = 'similar') as s, avg(content_similarity_score) as c, avg(text_similarity_score) as t from similarity_results)
select 'Export Date' as metric, '{NOW}' as value union all select 'Total Documents', count(*)::varchar from documents union all select 'Total Paragraphs', count(*)::varchar from paragraphs
union all select 'Total Similarity Matches', n::varchar from res union all select 'Exact Matches', e::varchar from res union all select 'Similar Matches', s::varchar from res
union all select 'Average Content Similarity', coalesce(printf('%.2f%%', c * 100), 'N/A') from res union all select 'Average Text Similarity', coalesce(printf('%.2f%%', t * 100), 'N/A') from res
union all select 'Total Tags', count(*)::varchar from tags union all select 'Total Clusters', count(*)::varchar from c""")
def _(spark, held):
    _made(held)
    one = P.side_by_side(P.summary(held.table("documents"), held.table("paragraphs"), held.table("tags"), held.table("similarity_results")).drop("mean_content", "mean_text"),
                         held.table("similarity_results").agg(F.avg("content_similarity_score").alias("c"), F.avg("text_similarity_score").alias("t")), held.table("clusters").agg(F.count(F.lit(1)).alias("clusters")))
    percent = lambda c: F.coalesce(F.format_string("%.2f%%", C(c) * 100), F.lit("N/A"))
    metrics = {"Export Date": F.lit(NOW), "Total Documents": C("documents"), "Total Paragraphs": C("paragraphs"), "Total Similarity Matches": C("results"), "Exact Matches": C("exact"), "Similar Matches": C("similar"),
               "Average Content Similarity": F.when(C("c").isNotNull(), percent("c")).otherwise("N/A"), "Average Text Similarity": F.when(C("t").isNotNull(), percent("t")).otherwise("N/A"), "Total Tags": C("tags"), "Total Clusters": C("clusters")}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("string").alias("value")) for k, v in metrics.items()])).alias("m")).select("m.*")
