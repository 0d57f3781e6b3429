"""Pairwise matches consolidated into groups (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, drop_cut, table

#: A row links its two paragraphs from this content score on.
MIN_SCORE = 0.8
#: Rounds of breadth-first search before what was reached is contracted to one vertex and the rest left to
#: minimum propagation. This bounds the number of jobs on long chains; it leaves nothing out.
PEEL_ROUNDS = 4


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _degree_top(edges: DataFrame):
    """The vertex of highest degree, the smallest id on a tie; None without edges."""
    row = _both_ways(edges).groupBy("a").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "a").limit(1).collect()
    return row[0].a if row else None


def peel(edges: DataFrame, start: int, rounds: int = PEEL_ROUNDS) -> DataFrame:
    """Vertices (v) reached from ``start`` within ``rounds`` rounds of frontier joins; fewer where none are new."""
    spark = edges.sparkSession
    reached = frontier = spark.createDataFrame([(start,)], "v long")
    for _ in range(rounds):
        new = _both_ways(edges).join(frontier.select(F.col("v").alias("a")), "a", "left_semi").select(F.col("b").alias("v")).distinct()
        frontier = cut(new.join(reached, "v", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def _jump(to: DataFrame) -> DataFrame:
    """Every vertex mapped two steps at once."""
    onward = to.select(F.col("v").alias("m"), F.col("m").alias("far"))
    return to.join(onward, "m", "left").select("v", F.coalesce("far", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(v, group_id) of every vertex of an undirected graph: the smallest id linked to it directly or indirectly.

    ``edges`` has long columns a and b; loops, nulls, repeated rows and either order are fine, vertices without another
    end have no row, and an empty table gives none. The component around the vertex of highest degree, where a giant
    one lies, is peeled by frontier joins and contracted. The rest is labelled by minimum propagation: every vertex
    takes its smallest neighbour, chains of such steps are shortened by jumping, and the edges are relabelled, which
    shrinks them at each round; a chain of any length ends after a logarithmic number of rounds.
    """
    clean = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct()
    left = cut(clean, "edges")
    labels = left.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    top = _degree_top(left)
    if top is None:
        return labels.select("v", F.col("v").alias("group_id"))
    giant = cut(peel(left, top), "giant")
    least = giant.agg(F.min("v")).first()[0]
    labels = cut(labels.join(giant.withColumn("in", F.lit(True)), "v", "left").select("v", F.when(F.col("in"), F.lit(least)).otherwise(F.col("v")).alias("m")), "labels")

    def relabelled(edges: DataFrame, to: DataFrame) -> DataFrame:
        at_a = to.select(F.col("v").alias("a"), F.col("m").alias("x"))
        at_b = to.select(F.col("v").alias("b"), F.col("m").alias("y"))
        moved = edges.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
        return moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    # edges inside the giant part vanish here; those that lead out of it now start at its smallest vertex
    old, left = left, cut(relabelled(left, giant.select("v", F.lit(least).alias("m"))), "edges")
    drop_cut(old)
    while not left.isEmpty():
        step = _both_ways(left).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m"))
        to = cut(_jump(_jump(step)), "steps")
        old_labels, old_edges = labels, left
        labels = cut(labels.join(to.select(F.col("v").alias("m"), F.col("m").alias("next")), "m", "left").select("v", F.coalesce("next", "m").alias("m")), "labels")
        left = cut(relabelled(left, to), "edges")
        for done in (old_labels, old_edges, to):
            drop_cut(done)
    return labels.select("v", F.col("m").alias("group_id"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): the rows of similarity_results that link two different, existing paragraphs."""
    rows = table(spark, sf_dir, "similarity_results").filter(F.col("content_similarity_score") >= MIN_SCORE)
    pairs = rows.select(F.col("paragraph1_id").alias("a"), F.col("paragraph2_id").alias("b")).filter("a <> b").distinct()
    ids = table(spark, sf_dir, "paragraphs").select("id")
    return pairs.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(linked(spark, sf_dir)).select("group_id", F.col("v").alias("paragraph_id"))


def p6_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group of linked paragraphs: its size and the number of different pairs that link it."""
    pairs = linked(spark, sf_dir)
    groups = components(pairs)
    links = pairs.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("w")).distinct().join(groups, "v").groupBy("group_id").agg(F.count(F.lit(1)).alias("links"))
    return groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("paragraphs")).join(links, "group_id")


QUERIES = {"p6_found": p6_found, "p6_sizes": p6_sizes}
_LINKS = """with recursive l as (select distinct least(paragraph1_id, paragraph2_id) a, greatest(paragraph1_id, paragraph2_id) b
from similarity_results where content_similarity_score >= 0.8 and paragraph1_id <> paragraph2_id
and paragraph1_id in (select id from paragraphs) and paragraph2_id in (select id from paragraphs)),
e as (select a, b from l union select b, a from l),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)"""
SQL = {
    "p6_found": f"{_LINKS} select least(min(b), a) as group_id, a as paragraph_id from r group by a",
    "p6_sizes": f"""{_LINKS}, g as (select least(min(b), a) as group_id, a from r group by a)
select group_id, count(*) as paragraphs, (select count(*) from l join g h on l.a = h.a where h.group_id = g.group_id) as links from g group by group_id""",
}
