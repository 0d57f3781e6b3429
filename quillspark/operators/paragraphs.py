"""Operators on the paragraph tables: search, duplicates, references, reports, and tables after mutations.

Every operator is a function from DataFrames to a DataFrame. Orders are total (ties end with the id). Null contents are
no duplicates of each other where contents are compared; an empty table gives an empty result, or zeros in a one-row
report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut

C = F.col
#: What one page may hold.
PAGE_SIZES = (10, 100)
# Tags that a new database starts with, and their colours.
DEFAULT_TAGS = [("Header", "#007bff"), ("Footer", "#6c757d"), ("Disclaimer", "#dc3545"), ("Important", "#ffc107"), ("Common", "#28a745")]


def digest(text: str) -> Column:
    """128 bits that stand for a text in groups, joins and their exchanges; null for null."""
    return F.unhex(F.substring(F.sha2(C(text), 256), 1, 32))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place in an order over the whole table, from 1. Rows are range-partitioned and numbered within
    partitions; only the partitions' sizes are added up, so no task sees all rows, nor all rows of one key. The
    numbered partitions are written once, as a second sampling of the ranges could place rows otherwise."""
    placed = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    local = cut(placed.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order))), "numbered")
    sizes = local.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    # one row per partition
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before), "__part").withColumn(name, (C("__n") + C("__before")).cast("long")).drop("__part", "__n", "__size", "__before")


def before_each(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Rows with ``columns`` of the row before in the same group, as ``previous_...`` (null for the first). Groups are
    not gathered: all rows are numbered in one order, and each meets the one before by its number."""
    n = cut(numbered(rows, [*[C(k).asc_nulls_first() for k in keys], *order], "__at"), "ordered")
    last = n.select((C("__at") + 1).alias("__at"), *[C(k).alias(f"__{k}") for k in keys], *[C(c).alias(f"__previous_{c}") for c in columns])
    joined = n.join(last, "__at", "left")
    same = reduce(lambda x, y: x & y, [C(k).eqNullSafe(C(f"__{k}")) for k in keys])
    return joined.select(*[c for c in n.columns if c != "__at"], C("__at").alias("place"), *[F.when(same, C(f"__previous_{c}")).alias(f"previous_{c}") for c in columns])


def segments(rows: DataFrame, starts: Column) -> DataFrame:
    """Rows that have ``place``, their dense number over the whole table, with ``segment``: the place of the last row up
    to them that meets ``starts``, as the first row must. No key or segment is gathered."""
    # place minus rank among the rows that start nothing is the same all along what follows a start
    going = numbered(rows.filter(~starts).select("place"), [C("place")], "__k").select("place", (C("place") - C("__k")).alias("__island"))
    begun = going.groupBy("__island").agg((F.min("place") - 1).alias("segment"))
    return rows.join(going.join(begun, "__island").select("place", "segment"), "place", "left").withColumn("segment", F.coalesce("segment", "place"))


def page_size(asked: int) -> int:
    """The page size within PAGE_SIZES that is nearest to what is asked for."""
    return min(max(asked, PAGE_SIZES[0]), PAGE_SIZES[1])


def page(rows: DataFrame, order: list[Column], page: int = 1, per_page: int = 25) -> DataFrame:
    """One page of rows in an order; the page size is kept within PAGE_SIZES."""
    size = page_size(per_page)
    return rows.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def list_items(paragraphs: DataFrame) -> DataFrame:
    """(id, place, item): the items of each list, from 1, with the lines that go on an item put to it; blank lines and
    what stands before the first item drop out. Lines are those of one content, so no more than that meets in a task."""
    lines = F.filter(F.transform(F.split("content", "\n"), T.collapsed), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), x.rlike(T.LIST_ITEM).alias("item")))
    # the items so far; a line that begins none is put to the last one
    items = F.aggregate(marked, F.array().cast("array<string>"), lambda done, x: F.when(x["item"], F.concat(done, F.array(x["line"]))).when(
        F.size(done) > 0, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" "), x["line"])))).otherwise(done))
    return paragraphs.select("id", F.posexplode(items).alias("place", "item")).select("id", (C("place") + 1).cast("long").alias("place"), "item")


def page_bounds(total: int, page: int, per_page: int) -> tuple[int, int]:
    """The number of pages, and the page that is shown when ``page`` is asked for."""
    pages = max(1, -(-total // per_page))
    return pages, min(max(page, 1), pages)


def search(paragraphs: DataFrame, document_id: int | None = None, paragraph_type: str | None = None, tag_id: int | None = None, paragraph_tags: DataFrame | None = None, min_length: int = 0, text: str | None = None) -> DataFrame:
    """Paragraphs that meet every condition given. ``text`` is searched in any case; % and _ in it are wildcards."""
    out = paragraphs
    if document_id:
        out = out.filter(C("document_id") == document_id)
    if paragraph_type:
        out = out.filter(C("paragraph_type") == paragraph_type)
    if tag_id is not None and paragraph_tags is not None:
        out = out.join(paragraph_tags.filter(C("tag_id") == tag_id).select(C("paragraph_id").alias("id")), "id", "left_semi")
    if min_length > 0:
        out = out.filter(F.length("content") >= min_length)
    if text:
        out = out.filter(C("content").ilike(f"%{text}%"))
    return out


def with_documents(paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    """Paragraphs with the filename of their document; paragraphs of no document drop out."""
    return paragraphs.join(documents.select(C("doc_id").alias("document_id"), "filename"), "document_id")


def tag_lists(paragraph_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, tags): the names of each paragraph's tags in order, joined by commas. A paragraph has at most all tags."""
    named = paragraph_tags.distinct().join(F.broadcast(tags.select(C("id").alias("tag_id"), "tag_name")), "tag_id")
    return named.groupBy(C("paragraph_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("tag_name")), ", ").alias("tags"))


def tag_usage(tags: DataFrame, paragraph_tags: DataFrame) -> DataFrame:
    """Tags with the number of paragraphs that bear them, repeated rows counted once, unused tags with 0."""
    used = paragraph_tags.distinct().groupBy(C("tag_id").alias("id")).agg(F.count("paragraph_id").alias("paragraphs"))
    return tags.join(used, "id", "left").select("id", "tag_name", "color", F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"))


def pair_contents(results: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Results with the contents of both paragraphs; rows of paragraphs that don't exist drop out."""
    side = lambda k: paragraphs.select(C("id").alias(f"paragraph{k}_id"), C("content").alias(f"content{k}"), C("document_id").alias(f"document{k}_id"))
    return results.join(side(1), "paragraph1_id").join(side(2), "paragraph2_id")


def similar_pairs(results: DataFrame, paragraphs: DataFrame, documents: DataFrame, threshold: float) -> DataFrame:
    names = lambda k: documents.select(C("doc_id").alias(f"document{k}_id"), C("filename").alias(f"filename{k}"))
    pairs = pair_contents(results.filter(C("content_similarity_score") >= threshold), paragraphs)
    return pairs.join(names(1), "document1_id").join(names(2), "document2_id").select(
        "id", "paragraph1_id", "paragraph2_id", "content1", "content2", "filename1", "filename2", "content_similarity_score", "text_similarity_score", "similarity_type")


def listed(column: str) -> Column:
    """A list written in either notation (JSON or single quotes), sorted and joined by semicolons. Null stays null."""
    quoted = F.regexp_extract_all(column, F.lit("[\"']([^\"']*)[\"']"), F.lit(1))
    return F.when(C(column).isNotNull(), F.nullif(F.array_join(F.sort_array(F.filter(quoted, lambda x: x != "")), "; "), F.lit("")))


def allowed(filename: str) -> Column:
    return C(filename).rlike(r"(?i)\.(pdf|docx?)$")


def with_occurrences(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with the number of rows of equal content; digests are counted before the shuffle and joined back, so a
    content of any frequency is split over tasks. A null content occurs once."""
    hashed = paragraphs.withColumn("__h", digest("content"))
    counts = hashed.filter("__h is not null").groupBy("__h").agg(F.count(F.lit(1)).alias("occurrences"))
    joined = hashed.join(counts, "__h", "left").drop("__h")
    return joined.withColumn("occurrences", F.coalesce("occurrences", F.lit(1)))


def raw_classes(paragraphs: DataFrame) -> DataFrame:
    """(id, class_id, duplicates) of every paragraph whose very content stands in another row."""
    rows = paragraphs.filter("content is not null").select("id", digest("content").alias("h"))
    classes = rows.groupBy("h").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(classes, "h").select("id", "class_id", (C("n") - 1).alias("duplicates"))


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; Spark drops all but each task's first rows before the shuffle."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def collapsed(paragraphs: DataFrame) -> DataFrame:
    """The row of smallest id of each content; null is a content here."""
    return first_of(paragraphs.withColumn("__h", digest("content")), ["__h"], [C("id")]).drop("__h")


def connections(results: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(document_id, similarity_connections): results with an end in each document; one with both ends counts once."""
    ends = results.select(C("id").alias("result"), F.explode(F.array("paragraph1_id", "paragraph2_id")).alias("id"))
    return ends.join(paragraphs.select("id", "document_id"), "id").select("result", "document_id").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("similarity_connections"))


def statistics(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """One row: documents, paragraphs, different contents, and contents in several rows."""
    contents = paragraphs.groupBy(digest("content").alias("h")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_paragraphs"), F.count("h").alias("unique_paragraphs"),
        F.count_if((C("n") > 1) & C("h").isNotNull()).alias("duplicate_paragraphs"))
    return side_by_side(documents.agg(F.count(F.lit(1)).alias("total_documents")), contents)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row frames as one row, joined on a constant."""
    return reduce(lambda a, b: a.join(b, "__one"), [r.withColumn("__one", F.lit(1)) for r in rows]).drop("__one")


def references(paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    """(class_id, id, document_id, filename, occurrences, appears_in_multiple): every paragraph of a document, with the
    smallest id of its content and the number of rows that hold it. The references of a content are the rows of its
    class, so no list grows with it; null contents have none."""
    rows = paragraphs.filter("content is not null").select("id", "document_id", digest("content").alias("h")).join(documents.select(C("doc_id").alias("document_id"), "filename"), "document_id")
    classes = rows.groupBy("h").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("occurrences"))
    return rows.join(classes, "h").select("class_id", "id", "document_id", "filename", "occurrences", (C("occurrences") > 1).alias("appears_in_multiple"))


def duplicate_groups(paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    """(class_id, copies, id, document_id, filename): the members of contents in several rows."""
    return references(paragraphs, documents).filter("occurrences > 1").select("class_id", C("occurrences").alias("copies"), "id", "document_id", "filename")


def type_histogram(paragraphs: DataFrame, key: str) -> DataFrame:
    """(key, types): kinds of paragraphs with their numbers, by name."""
    counts = paragraphs.groupBy(key, "paragraph_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("paragraph_type", "n"))), lambda x: F.concat(x["paragraph_type"], F.lit(": "), x["n"].cast("string"))), "; ").alias("types"))


def document_report(documents: DataFrame, paragraphs: DataFrame, results: DataFrame) -> DataFrame:
    counts = paragraphs.groupBy(C("document_id").alias("doc_id")).agg(F.count("id").alias("paragraphs"), F.sum(T.word_count("content")).alias("words"), F.sum(F.length("content")).alias("characters"))
    types = type_histogram(paragraphs, "document_id").withColumnRenamed("document_id", "doc_id")
    links = connections(results, paragraphs).select(C("document_id").alias("doc_id"), C("similarity_connections").alias("connections"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return documents.select("doc_id", "filename").join(counts, "doc_id", "left").join(types, "doc_id", "left").join(links, "doc_id", "left").select(
        "doc_id", "filename", zero("paragraphs"), zero("words"), zero("characters"), F.coalesce("types", F.lit("")).alias("types"), zero("connections"))


def tag_report(tags: DataFrame, paragraph_tags: DataFrame, paragraphs: DataFrame) -> DataFrame:
    borne = paragraph_tags.distinct().join(paragraphs.select(C("id").alias("paragraph_id"), "document_id"), "paragraph_id")
    per_document = borne.groupBy("tag_id", "document_id").agg(F.count(F.lit(1)).alias("n"))
    per_tag = per_document.groupBy(C("tag_id").alias("id")).agg(F.sum("n").alias("paragraphs"), F.count("document_id").alias("documents"))
    return tags.select("id", "tag_name").join(per_tag, "id", "left").select("id", "tag_name", F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"), F.coalesce("documents", F.lit(0)).alias("documents"))


def summary(documents: DataFrame, paragraphs: DataFrame, tags: DataFrame, results: DataFrame) -> DataFrame:
    one = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    return side_by_side(one(documents, "documents"), one(paragraphs, "paragraphs"), one(tags, "tags"), results.agg(
        F.count(F.lit(1)).alias("results"), F.count_if(C("similarity_type") == "exact").alias("exact"), F.count_if(C("similarity_type") == "similar").alias("similar"),
        F.round(F.avg("content_similarity_score"), 6).alias("mean_content"), F.round(F.avg("text_similarity_score"), 6).alias("mean_text")))


def _in_document() -> list[Column]:
    return [C("para_position").asc_nulls_first(), C("id")]


def positions(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with their number within the document, from 0, without gaps."""
    placed = cut(numbered(paragraphs, [C("document_id").asc_nulls_first(), *_in_document()], "__at"), "placed")
    first = placed.groupBy("document_id").agg(F.min("__at").alias("__first"))
    joined = placed.join(first.withColumnRenamed("document_id", "__d"), C("document_id").eqNullSafe(C("__d")))
    return joined.withColumn("sequence", C("__at") - C("__first")).drop("__at", "__first", "__d")


def headed(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with the header right before them in their document and column; headers themselves have none. Only
    keys are put in order; contents are fetched for the headers that are found."""
    keys = paragraphs.select("id", "document_id", "column_no", "para_position", "paragraph_type")
    rows = before_each(keys, ["document_id", "column_no"], _in_document(), ["paragraph_type", "id"])
    is_header = lambda c: F.coalesce(C(c).isin("header", "heading"), F.lit(False))
    led = rows.filter(is_header("previous_paragraph_type") & ~is_header("paragraph_type")).select("id", C("previous_id").alias("__header"))
    found = led.dropDuplicates(["id"]).join(paragraphs.select(C("id").alias("__header"), C("content").alias("header")).dropDuplicates(["__header"]), "__header").select("id", "header")
    return paragraphs.join(found, "id", "left")


def replaced_results(results: DataFrame) -> DataFrame:
    """The table of results after it is replaced: one row per unordered pair with its best score, numbered anew."""
    pairs = results.filter("paragraph1_id <> paragraph2_id").groupBy(F.least("paragraph1_id", "paragraph2_id").alias("paragraph1_id"), F.greatest("paragraph1_id", "paragraph2_id").alias("paragraph2_id")).agg(
        F.max("content_similarity_score").alias("content_similarity_score"))
    return numbered(pairs, [C("paragraph1_id"), C("paragraph2_id")], "id")


def with_default_tags(tags: DataFrame) -> DataFrame:
    """Tags with the default ones that aren't there yet, numbered on from the highest id in their order. There are few
    tags."""
    new = tags.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(DEFAULT_TAGS)], "k int, tag_name string, color string").join(tags.select("tag_name"), "tag_name", "left_anti")
    top = tags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = side_by_side_all(new, top).select((C("top") + F.row_number().over(Window.orderBy("k"))).alias("id"), "tag_name", "color")
    return tags.select("id", "tag_name", "color").unionByName(rows)


def side_by_side_all(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row frame."""
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(one.withColumn("__one", F.lit(1))), "__one").drop("__one")


def tagged_duplicates(paragraph_tags: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(paragraph_id, tag_id) after every tag is carried to all rows of equal content."""
    rows = paragraphs.filter("content is not null").select(C("id").alias("paragraph_id"), digest("content").alias("h"))
    held = paragraph_tags.distinct()
    per_content = held.join(rows, "paragraph_id").select("h", "tag_id").distinct()
    return held.unionByName(rows.join(per_content, "h").select("paragraph_id", "tag_id")).distinct()


def untagged_duplicates(paragraph_tags: DataFrame, paragraphs: DataFrame, which: DataFrame) -> DataFrame:
    """(paragraph_id, tag_id) after the tags in ``which`` are taken from all rows of equal content."""
    rows = paragraphs.filter("content is not null").select(C("id").alias("paragraph_id"), digest("content").alias("h"))
    gone = which.join(rows, "paragraph_id").select("h", "tag_id").distinct().join(rows, "h").select("paragraph_id", "tag_id")
    return paragraph_tags.distinct().join(gone, ["paragraph_id", "tag_id"], "left_anti")


def without_document(tables: dict[str, DataFrame], document_id: int) -> dict[str, DataFrame]:
    """The tables after a document is deleted with all that hangs on it."""
    gone = tables["paragraphs"].filter(C("document_id") == document_id).select("id")
    results = tables["similarity_results"]
    for k in (1, 2):
        results = results.join(gone.select(C("id").alias(f"paragraph{k}_id")), f"paragraph{k}_id", "left_anti")
    return {
        "documents": tables["documents"].filter(C("doc_id") != document_id), "paragraphs": tables["paragraphs"].filter(C("document_id") != document_id),
        "document_file_metadata": tables["document_file_metadata"].filter(C("document_id") != document_id), "similarity_results": results,
        "paragraph_tags": tables["paragraph_tags"].distinct().join(gone.select(C("id").alias("paragraph_id")), "paragraph_id", "left_anti")}


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, rows in tables.items()])
