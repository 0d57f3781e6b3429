"""The tables of a paragraph library and every change to them, kept in a :class:`~.store.Store`.

A change writes only the tables that it changes; the others are read from where they came. Numbers of new rows go on
from the highest one. What fails gives -1 or False, as nothing has been written then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import paragraphs as P
from .store import Store

C = F.col
#: Tables that a cleared library keeps.
PRESERVED = ("tags",)


class Library:
    """Tables by name: those of ``base`` until they are changed."""

    def __init__(self, spark: SparkSession, root: str, base: dict[str, DataFrame]) -> None:
        self.spark, self.base, self.store = spark, base, Store(spark, root)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name) if name in self.store else self.base[name]

    def _append(self, name: str, rows: DataFrame, key: str = "id", order=None) -> DataFrame:
        if name not in self.store:
            self.store.write(name, self.base[name])
        return self.store.append(name, rows, key, order)

    def _write(self, name: str, rows: DataFrame) -> DataFrame:
        return self.store.write(name, rows)

    def _top(self, name: str, key: str = "id") -> int:
        return self.table(name).agg(F.coalesce(F.max(key), F.lit(0))).first()[0]

    # --- documents and paragraphs ---

    def add_document(self, filename: str | None, file_type: str, file_path: str, upload_date: str) -> int:
        """The number of the new document, or -1 without a filename."""
        if not filename:
            return -1
        row = self.spark.createDataFrame([(filename, file_type, file_path, upload_date)], "filename string, file_type string, file_path string, upload_date string")
        self._append("documents", row, "doc_id")
        return self._top("documents", "doc_id")

    def add_paragraphs(self, rows: DataFrame) -> tuple[int, int]:
        """The first and last number of new paragraphs, numbered by document and position; (0, -1) for none."""
        if rows.isEmpty():
            return 0, -1
        before = self._top("paragraphs")
        self._append("paragraphs", rows, order=[C("document_id"), C("para_position"), C("content")])
        return before + 1, self._top("paragraphs")

    def delete_document(self, document_id: int) -> None:
        """Delete a document with its paragraphs, metadata, results, tags and memberships."""
        names = [n for n in ("documents", "paragraphs", "document_file_metadata", "similarity_results", "paragraph_tags") if n in self.base]
        left = P.without_document({n: self.table(n) for n in names}, document_id)
        gone = self.table("paragraphs").filter(C("document_id") == document_id).select(C("id").alias("paragraph_id"))
        if "cluster_paragraphs" in self.base:
            left["cluster_paragraphs"] = self.table("cluster_paragraphs").join(gone, "paragraph_id", "left_anti")
        # paragraphs come last, as the others are told by them
        for name in sorted(left, key=lambda n: n == "paragraphs"):
            self._write(name, left[name])

    # --- metadata ---

    def upsert_metadata(self, document_id: int, **attributes) -> int:
        """Set the given attributes in the latest row of a document, or add a row; unknown attributes are left out."""
        rows = self.table("document_file_metadata")
        known = {k: v for k, v in attributes.items() if k in rows.columns and k not in ("id", "document_id")}
        last = rows.filter(C("document_id") == document_id).agg(F.max("id")).first()[0]
        if last is None:
            new = self.spark.range(1).select(F.lit(document_id).alias("document_id"), *[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in known.items()])
            self._append("document_file_metadata", new)
            return self._top("document_file_metadata")
        put = [F.when(C("id") == last, F.lit(known[c]).cast(rows.schema[c].dataType)).otherwise(C(c)).alias(c) if c in known else C(c) for c in rows.columns]
        self._write("document_file_metadata", rows.select(*put))
        return last

    def delete_metadata(self, document_id: int) -> bool:
        self._write("document_file_metadata", self.table("document_file_metadata").filter(~C("document_id").eqNullSafe(F.lit(document_id))))
        return True

    # --- results ---

    def replace_results(self, rows: DataFrame) -> int:
        """The number of results, which replace all before them; without any, those before stay."""
        if rows.isEmpty():
            return 0
        self._write("similarity_results", P.numbered(rows.drop("id"), [C("paragraph1_id"), C("paragraph2_id"), C("content_similarity_score"), C("similarity_type")], "id"))
        return self.table("similarity_results").count()

    def clear_results(self) -> int:
        """How many results there were."""
        n = self.table("similarity_results").count()
        self._write("similarity_results", self.table("similarity_results").limit(0))
        return n

    # --- tags ---

    def add_tag(self, name: str, color: str | None) -> int:
        """The number of the new tag, or -1 if there is one of that name."""
        if not self.table("tags").filter(C("tag_name") == name).isEmpty():
            return -1
        self._append("tags", self.spark.createDataFrame([(name, color)], "tag_name string, color string"))
        return self._top("tags")

    def add_default_tags(self) -> DataFrame:
        return self._write("tags", P.with_default_tags(self.table("tags")))

    def delete_tag(self, tag_id: int) -> bool:
        """Delete a tag with its uses; False if there is none."""
        tags = self.table("tags")
        if tags.filter(C("id") == tag_id).isEmpty():
            return False
        self._write("paragraph_tags", self.table("paragraph_tags").filter(C("tag_id") != tag_id).distinct())
        self._write("tags", tags.filter(C("id") != tag_id))
        return True

    def _selected(self, ids: DataFrame, duplicates: bool) -> DataFrame:
        """(paragraph_id) of the paragraphs chosen by id, with all of equal content if wanted."""
        rows = self.table("paragraphs").select("id", "content", F.xxhash64("content").alias("h"))
        chosen = rows.join(ids.select("id").distinct(), "id", "left_semi")
        if duplicates:
            same = rows.filter("content is not null").join(chosen.filter("content is not null").select("h", "content").distinct(), ["h", "content"], "left_semi")
            chosen = chosen.unionByName(same)
        return chosen.select(C("id").alias("paragraph_id")).distinct()

    def tag(self, ids: DataFrame, tag_id: int, duplicates: bool = True) -> DataFrame:
        """Tag paragraphs; a paragraph that has the tag keeps it once."""
        new = self._selected(ids, duplicates).withColumn("tag_id", F.lit(tag_id).cast("long"))
        return self._write("paragraph_tags", self.table("paragraph_tags").select("paragraph_id", "tag_id").unionByName(new).distinct())

    def untag(self, ids: DataFrame, tag_id: int, duplicates: bool = True) -> DataFrame:
        gone = self._selected(ids, duplicates).withColumn("tag_id", F.lit(tag_id).cast("long"))
        return self._write("paragraph_tags", self.table("paragraph_tags").distinct().join(gone, ["paragraph_id", "tag_id"], "left_anti"))

    # --- clusters ---

    def create_clusters(self, members: DataFrame, named: DataFrame, created: str) -> DataFrame:
        """Add the clusters of ``named`` (cluster_id, name, description, similarity_threshold, similarity_type) and their
        ``members`` (cluster_id, paragraph_id), both renumbered in the order of their old numbers."""
        top = self._top("clusters")
        numbers = P.numbered(named.select("cluster_id").distinct(), [C("cluster_id")], "n").select("cluster_id", (C("n") + top).alias("id"))
        rows = named.join(numbers, "cluster_id").withColumn("creation_date", F.lit(created)).drop("cluster_id")
        self._append("clusters", rows)
        return self.add_members(members.join(numbers, "cluster_id").select(C("id").alias("cluster_id"), "paragraph_id"))

    def add_members(self, members: DataFrame) -> DataFrame:
        """Add (cluster_id, paragraph_id) of existing clusters and paragraphs that aren't members yet."""
        held = self.table("cluster_paragraphs")
        new = members.distinct().join(self.table("paragraphs").select(C("id").alias("paragraph_id")), "paragraph_id", "left_semi").join(self.table("clusters").select(C("id").alias("cluster_id")), "cluster_id", "left_semi")
        return self._append("cluster_paragraphs", new.select("cluster_id", "paragraph_id").join(held, ["cluster_id", "paragraph_id"], "left_anti"), key="")

    def delete_cluster(self, cluster_id: int) -> bool:
        if self.table("clusters").filter(C("id") == cluster_id).isEmpty():
            return False
        for name, key in (("cluster_paragraphs", "cluster_id"), ("clusters", "id")):
            self._write(name, self.table(name).filter(C(key) != cluster_id))
        return True

    def clear_clusters(self) -> int:
        """How many clusters there were."""
        n = self.table("clusters").count()
        for name in ("cluster_paragraphs", "clusters"):
            self._write(name, self.table(name).limit(0))
        return n

    # --- inserts ---

    def add_insert(self, name: str | None, filename: str, file_type: str, file_path: str, upload_date: str) -> int:
        if not name:
            return -1
        self._append("inserts", self.spark.createDataFrame([(name, filename, file_type, file_path, upload_date)], "name string, filename string, file_type string, file_path string, upload_date string"))
        return self._top("inserts")

    def add_insert_pages(self, insert_id: int, pages: DataFrame) -> int:
        """The number of pages added from (page_number, content); -1 without such an insert."""
        if self.table("inserts").filter(C("id") == insert_id).isEmpty():
            return -1
        self._append("insert_pages", pages.select("page_number", "content").withColumn("insert_id", F.lit(insert_id).cast("long")), order=[C("page_number"), C("content")])
        return pages.count()

    def delete_insert(self, insert_id: int) -> bool:
        if self.table("inserts").filter(C("id") == insert_id).isEmpty():
            return False
        self._write("insert_pages", self.table("insert_pages").filter(C("insert_id") != insert_id))
        self._write("inserts", self.table("inserts").filter(C("id") != insert_id))
        return True

    def delete_insert_page(self, page_id: int) -> bool:
        """Delete one page; the numbers of the others stay."""
        if self.table("insert_pages").filter(C("id") == page_id).isEmpty():
            return False
        self._write("insert_pages", self.table("insert_pages").filter(C("id") != page_id))
        return True

    # --- all ---

    def clear(self) -> dict[str, int]:
        """Empty every table but those PRESERVED; how many rows each had."""
        counts = {}
        for name in self.base:
            if name not in PRESERVED:
                counts[name] = self.table(name).count()
                self._write(name, self.table(name).limit(0))
        return counts
