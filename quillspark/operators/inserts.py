"""Template pages found in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from .paragraphs import first_of
from .similarity import prefix_join

C = F.col


def lower_words(text: str):
    """Different words of a text in lower case as split by white space, punctuation kept."""
    return F.array_distinct(T.split_words(F.lower(C(text))))


def page_matches(insert_pages: DataFrame, document_pages: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(insert_page, document_id, document_page, score): the best page of each document for each page of an insert, the
    first one on a tie. Pages have page_id, of any type that orders, and content, document pages document_id too; blank
    pages match nothing."""
    # words are split once for all steps of the join
    a = cut(insert_pages.select(C("page_id").alias("id"), lower_words("content").alias("items")), "insert-words")
    b = cut(document_pages.select(C("page_id").alias("id"), lower_words("content").alias("items")), "page-words")
    scored = prefix_join(a, b, threshold).select(C("id_a").alias("insert_page"), C("id_b").alias("document_page"), "score")
    rows = scored.join(document_pages.select(C("page_id").alias("document_page"), "document_id"), "document_page")
    return first_of(rows, ["insert_page", "document_id"], [C("score").desc(), C("document_page")]).select("insert_page", "document_id", "document_page", "score")


def insert_matches(insert_pages: DataFrame, matches: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(insert_id, document_id, match_count, match_score, match_percentage): documents in which an insert's pages score
    ``threshold`` on average over all its pages, blank ones included."""
    pages = insert_pages.groupBy("insert_id").agg(F.count(F.lit(1)).alias("pages"))
    found = matches.join(insert_pages.select(C("page_id").alias("insert_page"), "insert_id"), "insert_page")
    out = found.groupBy("insert_id", "document_id").agg(F.count(F.lit(1)).alias("match_count"), F.sum("score").alias("total")).join(pages, "insert_id")
    return out.select("insert_id", "document_id", "match_count", (C("total") / C("pages")).alias("match_score"), (C("match_count") / C("pages")).alias("match_percentage")).filter(C("match_score") >= threshold)
