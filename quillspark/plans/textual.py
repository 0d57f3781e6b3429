"""Text functions, similarity, clusters, inserts and client-side analytics by their survey names, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import folds
from ..operators import graph as G
from ..operators import inserts as I
from ..operators import paragraphs as P
from ..operators import similarity as S
from ..session import spread, table
from ..sources import files
from .relational import instants

C, SQL, QUERIES = F.col, {}, {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(spark, lambda t: table(spark, sf_dir, t))
        if sql:
            SQL[name] = sql
        return build
    return add


_SP = T.SPACE
_KEY = rf"""trim(regexp_replace(trim(regexp_replace(lower(content), '{_SP}+', ' ', 'g')), '[,.;:!?"''()\[\]]', '', 'g'))"""
_CLEAN = rf"trim(regexp_replace(regexp_replace(lower(content), '{T.NOT_WORD}', '', 'g'), '{_SP}+', ' ', 'g'))"
_SPLIT = lambda x: rf"list_filter(regexp_split_to_array({x}, '{_SP}+'), lambda x: x <> '')"
_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(set(T.STOPWORDS))) + ")"
_TOKENS = f"list_filter({_SPLIT(_CLEAN)}, lambda x: x not in {_STOP})"


@query("D1_normalized", f"select id, {_KEY} as key from paragraphs")
def _(spark, t):
    return spread(t("paragraphs")).select("id", T.exact_key("content").alias("key"))


@query("D2_shingles", f"""with c as (select id, {_CLEAN} as c from paragraphs), k as (select id, c, case when length(c) < 30 then 2 else 3 end as k from c)
select id, case when length(c) < k then '' else array_to_string(list_transform(range(1, length(c) - k + 2), lambda i: substring(c, i, k)), '~') end as shingles from k""")
def _(spark, t):
    return spread(t("paragraphs")).select("id", T.cleaned("content").alias("cleaned")).select("id", F.array_join(T.shingles("cleaned"), "~").alias("shingles"))


@query("D3_tokens", f"select id, array_to_string({_TOKENS}, ' ') as tokens from paragraphs")
def _(spark, t):
    return spread(t("paragraphs")).select("id", F.array_join(T.tokens("content"), " ").alias("tokens"))


@query("D5_exact_classes", f"""with k as (select id, document_id, {_KEY} as key from paragraphs where document_id is not null), g as (select * from k where key <> ''),
c as (select key, min(id) as class_id, count(*) as copies from g group by key having count(distinct document_id) > 1)
select g.id, c.class_id, c.copies, c.copies - count(*) over (partition by g.key, g.document_id) as links from g join c on c.key = g.key""")
def _(spark, t):
    return S.exact_classes(spread(t("paragraphs")))


_REPS = "reps as (select content, min(id) as id, min(document_id) as f, max(document_id) as l from paragraphs where content is not null and document_id is not null and length(content) >= 10 group by content)"


@query("D7_D10_similar_classes", f"""with {_REPS}, k as (select id, f, l, {_KEY} as key, list_distinct({_TOKENS}) as w from reps), n as (select *, len(w) as n from k where len(w) > 0),
x as (select id, unnest(w) as item, n from n), p as (select a.id as id_a, b.id as id_b, a.n as n_a, b.n as n_b, count(*) as s from x a join x b on a.item = b.item and a.id < b.id group by all)
select id_a, id_b, s / (n_a + n_b - s) as content_score from p join k a on a.id = id_a join k b on b.id = id_b
where s / (n_a + n_b - s) >= 0.8 and a.key <> b.key and not (a.f = a.l and b.f = b.l and a.f = b.f)""")
def _(spark, t):
    return S.similar_classes(spread(t("paragraphs")), 0.8)


@query("D7_content_scores", f"""with w as (select id, list_distinct({_TOKENS}) as w from paragraphs) select s.id, round(case when len(list_distinct(list_concat(a.w, b.w))) = 0 then 0.0 else len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) end, 6) as content_score
from similarity_results s join w a on a.id = s.paragraph1_id join w b on b.id = s.paragraph2_id""")
def _(spark, t):
    x = P.pair_contents(t("similarity_results"), t("paragraphs"))
    return x.select("id", T.word_set("content1").alias("a"), T.word_set("content2").alias("b")).select("id", F.round(T.jaccard(C("a"), C("b")), 6).alias("content_score"))


@query("D8_D9_text_scores")
def _(spark, t):
    x = S.text_scores(P.pair_contents(t("similarity_results"), t("paragraphs")))
    return x.select("id", F.round("text_score", 6).alias("text_score"))


# What of the text score plain SQL can say: one text within the other, and the chunks of texts of over 1000 characters.
_LOW = lambda x: f"lower(trim({x}))"


@query("D9_long_text_scores", f"""with p as (select s.id, {_LOW('a.content')} as a, {_LOW('b.content')} as b from similarity_results s join paragraphs a on a.id = s.paragraph1_id join paragraphs b on b.id = s.paragraph2_id),
q as (select *, case when length(a) <= length(b) then a else b end as x, case when length(a) <= length(b) then b else a end as y, least(length(a), length(b)) as n from p where greatest(length(a), length(b)) > 200 and least(length(a), length(b)) >= 40),
c as (select id, x, y, n, least(100, n // 2) as size from q), k as (select id, y, n, unnest(list_transform(range(0, n, size // 2), lambda i: substring(x, i + 1, size))) as chunk from c)
select id, round(least(sum(case when length(chunk) >= 20 and contains(y, chunk) then length(chunk) else 0 end) / any_value(n), 1.0), 6) as chunk_score from k group by id""")
def _(spark, t):
    x = P.pair_contents(t("similarity_results"), t("paragraphs")).select("id", F.lower(F.trim("content1")).alias("a"), F.lower(F.trim("content2")).alias("b"))
    long = x.filter((F.greatest(F.length("a"), F.length("b")) > 200) & (F.least(F.length("a"), F.length("b")) >= 40))
    return long.select("id", F.round(S.chunked_score(C("a"), C("b")), 6).alias("chunk_score"))


@query("D10_full_search")
def _(spark, t):
    return S.full_search(spread(t("paragraphs")), 0.8)


@query("D6_lsh_pairs")
def _(spark, t):
    return S.lsh_pairs(spread(t("paragraphs")), 0.8)


@query("D4_signature_classes")
def _(spark, t):
    return S.signature_classes(spread(t("paragraphs")))


_GRAPH = """with recursive l as (select distinct least(paragraph1_id, paragraph2_id) a, greatest(paragraph1_id, paragraph2_id) b from similarity_results where content_similarity_score >= 0.8 and paragraph1_id <> paragraph2_id),
e as (select a, b from l union select b, a from l), r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a), g as (select a as id, least(min(b), a) as component from r group by a)"""


@query("D13_edges", "select least(paragraph1_id, paragraph2_id) as a, greatest(paragraph1_id, paragraph2_id) as b, max_by(content_similarity_score, id) as weight from similarity_results where content_similarity_score >= 0.8 and paragraph1_id <> paragraph2_id group by 1, 2")
def _(spark, t):
    return G.edges(t("similarity_results"), 0.8)


@query("D15_components", f"{_GRAPH} select id, component from g")
def _(spark, t):
    return G.components(G.edges(t("similarity_results"), 0.8))


@query("D14_communities")
def _(spark, t):
    links = G.edges(t("similarity_results"), 0.8)
    return G.communities(links, G.components(links))


@query("D16_S6_A14_A17_clusters", f"""{_GRAPH} select component as cluster_id, 'Cluster ' || component || ': ' || substring(first(p.content order by p.id), 1, 50) || '...' as name,
'Group of ' || count(*) || ' paragraphs with content similarity' as description, count(*) as paragraphs, count(distinct document_id) as documents, 0.8::double as similarity_threshold from g join paragraphs p on p.id = g.id group by component""")
def _(spark, t):
    labels = G.components(G.edges(t("similarity_results"), 0.8)).withColumnRenamed("component", "cluster_id")
    return G.clusters(labels, t("paragraphs"), 0.8)


@query("S7_cluster_paragraphs", f"{_GRAPH} select component as cluster_id, p.id, p.paragraph_type, coalesce(d.filename, 'Unknown') as filename from g join paragraphs p on p.id = g.id left join documents d on d.doc_id = p.document_id")
def _(spark, t):
    labels = G.components(G.edges(t("similarity_results"), 0.8)).withColumnRenamed("component", "cluster_id")
    names = t("documents").select(C("doc_id").alias("document_id"), "filename")
    return labels.join(t("paragraphs"), "id").join(names, "document_id", "left").select("cluster_id", "id", "paragraph_type", F.coalesce("filename", F.lit("Unknown")).alias("filename"))


@query("A17_cluster_types", f"{_GRAPH} select component as cluster_id, paragraph_type, count(*) as n from g join paragraphs p on p.id = g.id group by all")
def _(spark, t):
    labels = G.components(G.edges(t("similarity_results"), 0.8)).withColumnRenamed("component", "cluster_id")
    return labels.join(t("paragraphs"), "id").groupBy("cluster_id", "paragraph_type").agg(F.count(F.lit(1)).alias("n"))


@query("C1_A22_word_consistency", rf"""{_GRAPH}, w as (select component, p.id, unnest({_SPLIT('content')}) as word from g join paragraphs p on p.id = g.id), n as (select component, count(*) as n from g join paragraphs p on p.id = g.id group by component),
f as (select component, word, count(*) as f from w group by all) select f.component as cluster_id, word, f as frequency, round(f / n, 6) as consistency from f join n on n.component = f.component""")
def _(spark, t):
    labels = G.components(G.edges(t("similarity_results"), 0.8)).withColumnRenamed("component", "cluster_id")
    rows = labels.join(t("paragraphs").select("id", "content"), "id")
    sizes = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    words = rows.select("cluster_id", F.explode(T.split_words("content")).alias("word")).groupBy("cluster_id", "word").agg(F.count(F.lit(1)).alias("frequency"))
    return words.join(sizes, "cluster_id").select("cluster_id", "word", "frequency", F.round(C("frequency") / C("n"), 6).alias("consistency"))


@query("C2_O6_top_words", rf"select word, count(*) as frequency from (select unnest({_SPLIT('content')}) as word from paragraphs) group by word order by frequency desc, word limit 100")
def _(spark, t):
    return spread(t("paragraphs")).select(F.explode(T.split_words("content")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("frequency")).orderBy(C("frequency").desc(), "word").limit(100)


@query("C4_dates")
def _(spark, t):
    """(doc_id, shown, shown_with_time): the upload instant in UTC as day-month-year, without and with its time; - for none."""
    dated = t("documents").select("doc_id").join(instants(t), "doc_id")
    at = F.timestamp_micros("instant_us")
    shown = lambda form: F.coalesce(F.date_format(at, form), F.lit("-"))
    return dated.select("doc_id", shown("dd-MM-yyyy").alias("shown"), shown("dd-MM-yyyy HH:mm").alias("shown_with_time"))


_ISO = r"'^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$'"


@query("C4_iso_dates", f"select doc_id, strftime(cast(replace(replace(upload_date, 'T', ' '), 'Z', '') as timestamp), '%d-%m-%Y %H:%M') as shown from documents where regexp_matches(upload_date, {_ISO})")
def _(spark, t):
    dated = t("documents").filter(C("upload_date").rlike(_ISO[1:-1])).select("doc_id").join(instants(t), "doc_id")
    return dated.select("doc_id", F.date_format(F.timestamp_micros("instant_us"), "dd-MM-yyyy HH:mm").alias("shown"))


@query("S2_iso_documents_newest", f"select doc_id, row_number() over (order by cast(replace(replace(upload_date, 'T', ' '), 'Z', '') as timestamp) desc, doc_id) as place from documents where regexp_matches(upload_date, {_ISO})")
def _(spark, t):
    dated = t("documents").filter(C("upload_date").rlike(_ISO[1:-1])).select("doc_id").join(instants(t), "doc_id")
    return P.numbered(dated, [C("instant_us").desc_nulls_last(), C("doc_id")], "place").select("doc_id", "place")


@query("C5_C6_truncated", r"""select id, case when length(content) <= 100 then content else (case when regexp_extract(substring(content, 1, 101), '(?s)^(.*) ', 1) <> '' then regexp_extract(substring(content, 1, 101), '(?s)^(.*) ', 1) else substring(content, 1, 100) end) || '...' end as at_word,
case when length(content) <= 150 then content else substring(content, 1, 150) || '...' end as hard from paragraphs""")
def _(spark, t):
    return spread(t("paragraphs")).select("id", T.truncated("content", 100).alias("at_word"), T.cut_hard("content").alias("hard"))


@query("C7_C11_highlight", "select id, regexp_replace(content, '(?i)(contract)', '<mark>\\1</mark>', 'g') as marked, replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') as escaped from paragraphs")
def _(spark, t):
    return spread(t("paragraphs")).select("id", T.highlighted("content", "contract").alias("marked"), T.escaped_html("content").alias("escaped"))


@query("C8_C9_rates", "select source, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm ' || (s % 60) || 's' else (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' end as duration, dated from (select source, count(*) * 37 as s, round(100.0 * count(upload_date) / count(*), 1) as dated from documents group by source)")
def _(spark, t):
    per = t("documents").groupBy("source").agg((F.count(F.lit(1)) * 37).alias("s"), F.round(F.count("upload_date") * 100.0 / F.count(F.lit(1)), 1).alias("dated"))
    return per.select("source", T.duration_text("s").alias("duration"), "dated")


@query("C10_badges", "select id, case when content_similarity_score > 0.9 then 'high' when content_similarity_score > 0.8 then 'medium' else 'low' end as badge from similarity_results")
def _(spark, t):
    s = C("content_similarity_score")
    return t("similarity_results").select("id", F.when(s > 0.9, "high").when(s > 0.8, "medium").otherwise("low").alias("badge"))


_HEADER = rf"""(length(content) between 1 and 100 and right(content, 1) not in ('.', '?', '!', ':', ';', ',') and (regexp_matches(content, '^[\d.]+{_SP}+[\p{{L}}\p{{N}}_]') or (content = upper(content) and content <> lower(content))
or (regexp_matches(content, '[\p{{Lu}}\p{{Lt}}]') and not regexp_matches(content, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}][\p{{Lu}}\p{{Lt}}]') and not regexp_matches(content, '(^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}') and len({_SPLIT('content')}) <= 10) or len({_SPLIT('content')}) <= 6))"""
_ROW = rf"(regexp_matches(content, '(?s)\|.*\||\t|[\p{{L}}\p{{N}}_]{_SP}{{3,}}[\p{{L}}\p{{N}}_]|<tr>|<td>|<th>') or regexp_matches(content, '^\s*\|?\s*[-:]+\s*\|(?:\s*[-:]+\s*\|)*\s*$'))"
_ITEM = rf"(len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(trim(regexp_replace(x, '{_SP}+', ' ', 'g')), '{T.LIST_ITEM}'))) > 0)"
_ADDRESS = r"(regexp_matches(content, '\b[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}\b|\b\d{5}(-\d{4})?\b') and (" + " or ".join(f"contains(lower(content), '{w}')" for w in T.ADDRESS_WORDS) + "))"
_BOILER = r"(regexp_matches(content, '^\s*Page \d+ of \d+\s*$') or " + " or ".join(f"contains(lower(content), '{w}')" for w in T.BOILERPLATE) + ")"


@query("T1_classified", f"select id, case when {_HEADER} then 'header' when {_ROW} then 'table' when {_ITEM} then 'list' when {_ADDRESS} then 'address' when {_BOILER} then 'boilerplate' else 'normal' end as kind from paragraphs where trim(content) <> ''")
def _(spark, t):
    return spread(t("paragraphs")).filter(F.trim("content") != "").select("id", T.classified("content").alias("kind"))


@query("T2_T8_tests", rf"""select id, {_HEADER} as header, {_ROW} as table_row, {_ITEM} as list_item, {_ADDRESS} as address, {_BOILER} as boilerplate, contains(content, '..') and regexp_matches(content, '\d+\s*$') as toc, regexp_matches(content, ':{_SP}*$') as introduces from paragraphs where content <> ''""")
def _(spark, t):
    return spread(t("paragraphs")).filter("content <> ''").select("id", T.is_header("content").alias("header"), T.is_table("content").alias("table_row"), T.has_list_item("content").alias("list_item"), T.is_address("content").alias("address"),
                                  T.is_boilerplate("content").alias("boilerplate"), T.is_toc_entry("content").alias("toc"), T.introduces_list("content").alias("introduces"))


@query("T9_table_cells", "select id, array_to_string(list_filter(list_transform(string_split(content, '|'), lambda x: trim(x)), lambda x: x <> ''), ' | ') as cells from paragraphs where paragraph_type = 'table'")
def _(spark, t):
    return t("paragraphs").filter("paragraph_type = 'table'").select("id", F.array_join(F.filter(F.transform(F.split("content", r"\|"), lambda x: F.trim(x)), lambda x: x != ""), " | ").alias("cells"))


@query("T18_sizes", "select id, case when file_size < 1024 then printf('%.2f B', file_size::double) when file_size < 1048576 then printf('%.2f KB', file_size / 1024.0::double) when file_size < 1073741824 then printf('%.2f MB', file_size / 1048576.0::double) else printf('%.2f GB', file_size / 1073741824.0::double) end as shown from document_file_metadata where file_size is not null")
def _(spark, t):
    return t("document_file_metadata").filter("file_size is not null").select("id", T.size_text("file_size").alias("shown"))


@query("T19_pages", "select document_id, cast(round_even(greatest(sum(length(content)) / 3000, count(*) / 40, count(*) filter (paragraph_type = 'table') / 3, 1), 0) as int) as pages from paragraphs group by document_id")
def _(spark, t):
    per = t("paragraphs").groupBy("document_id").agg(F.sum(F.length("content")).alias("c"), F.count(F.lit(1)).alias("n"), F.count_if(C("paragraph_type") == "table").alias("k"))
    return per.select("document_id", T.estimated_pages("c", "n", "k").alias("pages"))


@query("T17_blank_line_blocks", r"select doc_id, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x) <> '')) as blocks from documents")
def _(spark, t):
    return t("documents").select("doc_id", F.size(F.filter(F.split("text", r"\n\s*\n"), lambda x: F.trim(x) != "")).cast("long").alias("blocks"))


@query("T21_legacy_types", "select id, case paragraph_type when 'heading' then 'header' when 'toc' then 'normal' when 'header' then 'header' when 'list' then 'list' when 'table' then 'table' when 'footer' then 'footer' when 'boilerplate' then 'boilerplate' else 'normal' end as kind from paragraphs")
def _(spark, t):
    kind = F.when(C("paragraph_type") == "heading", "header").when(C("paragraph_type").isin("header", "list", "table", "footer", "boilerplate"), C("paragraph_type")).otherwise("normal")
    return t("paragraphs").select("id", kind.alias("kind"))


@query("T23_names", r"select doc_id, regexp_extract(filename, '^(.*)\.[^.]*$', 1) as stem, lower(regexp_extract(filename, '\.([^.]*)$', 1)) as extension from documents where contains(filename, '.')")
def _(spark, t):
    return t("documents").filter(C("filename").contains(".")).select("doc_id", F.regexp_extract("filename", r"^(.*)\.[^.]*$", 1).alias("stem"), F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1)).alias("extension"))


@query("S22_T23_renamed_uploads", r"""select doc_id, filename, case when row_number() over (partition by filename order by doc_id) = 1 then filename when contains(filename, '.') then regexp_extract(filename, '^(.*)\.[^.]*$', 1) || '_20260101000000' ||
case when row_number() over (partition by filename order by doc_id) > 2 then '_' || (row_number() over (partition by filename order by doc_id) - 1) else '' end || '.' || regexp_extract(filename, '\.([^.]*)$', 1)
else filename || '_20260101000000' || case when row_number() over (partition by filename order by doc_id) > 2 then '_' || (row_number() over (partition by filename order by doc_id) - 1) else '' end end as stored from documents where filename is not null""")
def _(spark, t):
    return files.stored_names(t("documents").select("doc_id", "filename"), "doc_id", "20260101000000")


@query("T24_heading_levels", r"select id, coalesce(try_cast(regexp_extract(style, 'Heading (\d+)', 1) as int), 1) as level from (select id, case when id % 3 = 0 then 'Heading ' || (id % 7 + 1) when id % 3 = 1 then 'Heading' else 'Title' end as style from paragraphs where paragraph_type in ('header', 'heading'))")
def _(spark, t):
    style = F.when(C("id") % 3 == 0, F.concat(F.lit("Heading "), (C("id") % 7 + 1).cast("string"))).when(C("id") % 3 == 1, "Heading").otherwise("Title")
    return t("paragraphs").filter("paragraph_type in ('header', 'heading')").select("id", T.heading_level(style).alias("level"))


_MATCH = """with recursive a as (select item_id as page, list_distinct(list_filter(regexp_split_to_array(lower(text), '{s}+'), lambda x: x <> '')) as w from eval_items),
l as (select doc_id as document_id, unnest(string_split(text, chr(10))) as content, unnest(range(len(string_split(text, chr(10))))) as place from documents),
b as (select document_id, place, list_distinct(list_filter(regexp_split_to_array(lower(content), '{s}+'), lambda x: x <> '')) as w from l),
x as (select page, unnest(w) as item, len(w) as n from a), y as (select document_id, place, unnest(w) as item, len(w) as n from b),
p as (select x.page as insert_page, y.place, y.document_id, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) as score from x join y on x.item = y.item group by x.page, y.place, y.document_id),
m as (select * from p where score >= 0.7 qualify row_number() over (partition by insert_page, document_id order by score desc, place) = 1)""".replace("{s}", _SP)


def _pages(documents):
    """The lines of documents as their pages."""
    lines = documents.select(C("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("place", "content"))
    return lines.select(F.struct("document_id", "place").alias("page_id"), "document_id", "content")


@query("D11_W5_page_matches", _MATCH + " select insert_page, document_id, place, round(score, 6) as score from m")
def _(spark, t):
    pages = t("eval_items").select(C("item_id").alias("page_id"), C("text").alias("content"))
    return I.page_matches(pages, _pages(spread(t("documents"))), 0.7).select("insert_page", "document_id", C("document_page.place").cast("long").alias("place"), F.round("score", 6).alias("score"))


# every item an insert of its text, twice or with a blank page for two thirds of them
_BOOKS = "books as (select item_id, item_id as page from eval_items union all select item_id, item_id from eval_items where item_id % 3 = 0 union all select item_id, null from eval_items where item_id % 3 = 1)"


def _books(items):
    copies = F.when(C("item_id") % 3 == 0, F.array(F.lit("text"), F.lit("again"))).when(C("item_id") % 3 == 1, F.array(F.lit("text"), F.lit("blank"))).otherwise(F.array(F.lit("text")))
    rows = items.select("item_id", "text", F.explode(copies).alias("kind"))
    return rows.select(C("item_id").alias("insert_id"), F.struct("item_id", "kind").alias("page_id"), F.when(C("kind") == "blank", "").when(C("kind") == "again", F.upper("text")).otherwise(C("text")).alias("content"))


@query("D12_A20_insert_matches", _MATCH + f", {_BOOKS}, n as (select item_id, count(*) as pages from books group by item_id) select b.item_id as insert_id, document_id, count(*) as match_count, round(sum(score) / any_value(n.pages), 6) as match_score, round(count(*) / any_value(n.pages), 6) as match_percentage from books b join m on m.insert_page = b.page join n on n.item_id = b.item_id group by b.item_id, document_id having sum(score) / any_value(n.pages) >= 0.7")
def _(spark, t):
    pages = _books(t("eval_items"))
    # in the order of their scores, the smaller numbers first on a tie
    return I.insert_matches(pages, I.page_matches(pages, _pages(spread(t("documents"))), 0.7), 0.7).withColumns({c: F.round(c, 6) for c in ("match_score", "match_percentage")}).orderBy(C("match_score").desc(), "insert_id", "document_id")


@query("A23_insert_usage", _MATCH + " select e.suite as insert_id, count(distinct document_id) as documents, round(avg(score), 6) as mean_score from m join eval_items e on e.item_id = m.insert_page group by e.suite")
def _(spark, t):
    pages = t("eval_items").select(C("suite").alias("insert_id"), C("item_id").alias("page_id"), C("text").alias("content"))
    found = I.page_matches(pages, _pages(spread(t("documents"))), 0.7).join(pages.select("insert_id", C("page_id").alias("insert_page")), "insert_page")
    return found.groupBy("insert_id").agg(F.countDistinct("document_id").alias("documents"), F.round(F.avg("score"), 6).alias("mean_score"))


_TYPED = "paragraph_type in ('list', 'table')"


@query("W4_colon_attach", f"""with r as (select id, document_id, paragraph_type as kind, content, column_no as col, coalesce({_TYPED}, false) as el, row_number() over (partition by document_id order by para_position nulls first, id) as n from paragraphs where content is not null),
s as (select *, sum(case when el then 0 else 1 end) over (partition by document_id order by n rows unbounded preceding) as seg from r), t as (select *, row_number() over (partition by document_id, seg order by n) as k,
first(col) over (partition by document_id, seg order by n) as lead_col, first(el) over (partition by document_id, seg order by n) as lead_el, right(trim(content, ' ' || chr(9) || chr(10) || chr(13)), 1) = ':' as ends from s),
j as (select *, k > 1 and not lead_el and coalesce(bool_and(ends) over (partition by document_id, seg order by n rows between unbounded preceding and 1 preceding), false)
and bool_and(k = 1 or lead_col is null or col is null or lead_col = col) over (partition by document_id, seg order by n rows unbounded preceding) as joins from t),
g as (select *, case when k = 1 or joins then 0 when k = 2 and not lead_el or lag(joins) over (partition by document_id, seg order by n) or kind <> lag(kind) over (partition by document_id, seg order by n) then 1 else 0 end as new from j),
h as (select *, sum(new) over (partition by document_id, seg order by n rows unbounded preceding) as part from g)
select document_id, first(id order by n) as id, first(kind order by n) as kind, string_agg(content, chr(10) order by n) as content from h group by document_id, seg, part""")
def _(spark, t):
    return folds.attach_elements(t("paragraphs"))


_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^{_SP}+', ''), '{_SP}+$', '')"


@query("T15_split_long", rf"""with recursive s as (select id, content, regexp_extract_all(content, '(?s).*?[.!?]{_SP}+') as parts from paragraphs where content <> ''),
k as (select id, unnest(parts) as part, unnest(range(1, len(parts) + 1)) as n from s), e as (select id, n, sum(length(part)) over (partition by id order by n) as e from k),
r as (select id, 0 as n, 0 as start, 0 as added, null::hugeint as begun, null::hugeint as ended from s union all select r.id, e.n, case when added + e.e - start >= 500 then e.e else start end, case when added + e.e - start >= 500 then 0 else added + e.e - start end,
case when added + e.e - start >= 500 then start end, case when added + e.e - start >= 500 then e.e end from r join e on e.id = r.id and e.n = r.n + 1),
p as (select id, begun, ended from r where ended is not null), l as (select s.id, coalesce(max(p.ended), 0) as start, count(p.ended) as n from s left join p on p.id = s.id group by s.id),
a as (select id, begun, {_STRIP("substring(content, (begun + 1)::bigint, (ended - begun)::bigint)")} as content from p join s using (id) union all
select id, start, case when start = 0 then content else {_STRIP("substring(content, (start + 1)::bigint)")} end from l join s using (id) where start < length(content) or n = 0)
select id, row_number() over (partition by id order by begun) - 1 as piece, content from a""")
def _(spark, t):
    return folds.split_texts(spread(t("paragraphs")))


@query("T16_S18_packed_pages", """with recursive r as (select document_id, content, length(content) as n, row_number() over (partition by document_id order by para_position nulls first, id) as k from paragraphs where trim(content) <> ''),
p as (select document_id, k, content, n as used, 0 as page from r where k = 1 union all select r.document_id, r.k, r.content, case when p.used + r.n > 3000 then r.n else p.used + r.n end, case when p.used + r.n > 3000 then p.page + 1 else p.page end from p join r on r.document_id = p.document_id and r.k = p.k + 1)
select document_id, page as page_number, string_agg(content, chr(10) order by k) as content from p group by document_id, page""")
def _(spark, t):
    return folds.packed_pages(t("paragraphs"))
