"""The graph of similar paragraphs: components, communities, and the clusters made of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut, ship

C = F.col


def edges(results: DataFrame, threshold: float, score: str = "content_similarity_score") -> DataFrame:
    """(a, b, weight): each linked pair once, a < b, with the score of its last result. Loops and null scores are none."""
    rows = results.filter((C(score) >= threshold) & (C("paragraph1_id") != C("paragraph2_id")))
    pairs = rows.select(F.least("paragraph1_id", "paragraph2_id").alias("a"), F.greatest("paragraph1_id", "paragraph2_id").alias("b"), C(score).alias("weight"), "id")
    return pairs.groupBy("a", "b").agg(F.max_by("weight", "id").alias("weight"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every vertex of (a, b): the smallest id of its component. Each round takes the least label
    among neighbours and then the label of that label, so long chains shrink geometrically; labels are written to the
    shared folder between rounds."""
    ways = cut(links.select("a", "b").unionByName(links.select(C("b").alias("a"), C("a").alias("b"))).distinct(), "ways")
    labels = cut(ways.select(C("a").alias("id")).distinct().withColumn("component", C("id")), "labels")
    while True:
        near = ways.join(labels.select(C("id").alias("b"), "component"), "b").groupBy(C("a").alias("id")).agg(F.min("component").alias("near"))
        least = labels.join(near, "id").select("id", C("component").alias("was"), F.least("component", "near").alias("component"))
        # the root of each old component takes the least label that any member found
        roots = least.groupBy(C("was").alias("id")).agg(F.min("component").alias("hook"))
        hooked = cut(least.join(roots, "id", "left").select("id", "was", F.least("component", F.coalesce("hook", "component")).alias("component")), "hooked")
        far = hooked.select(C("id").alias("component"), C("component").alias("far"))
        new = cut(hooked.join(far, "component", "left").select("id", "was", F.least("component", F.coalesce("far", "component")).alias("component")), "labels")
        changed = not new.filter("was <> component").isEmpty()
        for old in (labels, hooked):
            drop_cut(old)
        labels = new
        if not changed:
            return labels.select("id", "component")


#: Components of so many links or fewer are partitioned in one task each.
MOST_LINKS = 100_000
#: A level of distributed moves ends when fewer than this share of the vertices moved.
SETTLED = 0.001


def communities(links: DataFrame, labels: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """(id, community): modularity communities within components, named by their smallest id.

    A component of up to ``most_links`` links is held by one task, which visits vertices in the order of ids until no
    move gains. Larger ones are partitioned by :func:`moved`, in which all vertices move at once. Both maximise the same
    modularity, measured against the total weight of the whole graph, and give the same result at each run."""
    total = links.agg(F.sum("weight")).first()[0] or 1.0
    rows = cut(links.join(labels.select(C("id").alias("a"), "component"), "a"), "component-links")
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(C("n") > most_links).select("component")
    small = rows.join(large, "component", "left_anti")
    ship(links.sparkSession)
    out = small.groupBy("component").applyInPandas(lambda group: local_moves(group, total), "id long, community long")
    giant = rows.join(large, "component", "left_semi").select("a", "b", "weight")
    return out if giant.isEmpty() else out.unionByName(moved(giant, total))


def moved(links: DataFrame, total: float) -> DataFrame:
    """(id, community) by distributed moves: in each round every community sees what its neighbours would gain, and those
    of one half, dealt anew each round, move; when few move, communities become vertices and the next level begins, until
    a level moves none. Each round costs joins on the links that are left and gathers no component."""
    ways = cut(links.select("a", "b", "weight").unionByName(links.select(C("b").alias("a"), C("a").alias("b"), "weight")), "ways")
    members = cut(ways.select(C("a").alias("id")).distinct().withColumn("v", C("id")), "members")
    while True:
        degree = ways.groupBy(C("a").alias("v")).agg(F.sum("weight").alias("degree"))
        at = cut(degree.withColumn("c", C("v")), "at")
        count, gained, round_ = at.count(), 0, 0
        while True:
            mass = at.groupBy("c").agg(F.sum("degree").alias("mass"))
            near = ways.filter("a <> b").join(at.select(C("v").alias("b"), C("c").alias("to")), "b").groupBy(C("a").alias("v"), "to").agg(F.sum("weight").alias("w"))
            seen = near.join(at, "v").join(mass.withColumnRenamed("c", "to"), "to")
            gain = C("w") - (C("mass") - F.when(C("to") == C("c"), C("degree")).otherwise(0.0)) * C("degree") / (2 * total)
            best = seen.withColumn("gain", gain).groupBy("v").agg(F.max_by("to", F.struct("gain", -C("to"))).alias("to"), F.max("gain").alias("gain"), F.max(F.when(C("to") == C("c"), C("gain"))).alias("stay"))
            # alone in its community, a vertex gains nothing by staying
            better = C("gain") > F.coalesce("stay", F.lit(0.0)) + 1e-12
            mine = F.pmod(F.xxhash64("v", F.lit(round_)), F.lit(2)) == 0
            new = cut(at.join(best, "v", "left").select("v", "degree", F.when(better & mine, C("to")).otherwise(C("c")).alias("c"), (F.coalesce(better & mine & (C("to") != C("c")), F.lit(False))).alias("went")), "at")
            went = new.filter("went").count()
            drop_cut(at)
            at, gained, round_ = new.drop("went"), gained + went, round_ + 1
            at._quill_path = new._quill_path
            if went <= SETTLED * count and round_ % 2 == 0 or round_ >= 32:
                break
        old_members, old_ways = members, ways
        members = cut(members.join(at.select("v", "c"), "v").select("id", C("c").alias("v")), "members")
        to = at.select(C("v").alias("a"), C("c").alias("x"))
        ways = cut(ways.join(to, "a").join(to.select(C("a").alias("b"), C("x").alias("y")), "b").groupBy(C("x").alias("a"), C("y").alias("b")).agg(F.sum("weight").alias("weight")), "ways")
        for done in (old_members, old_ways, at):
            drop_cut(done)
        if gained <= SETTLED * count:
            names = members.groupBy("v").agg(F.min("id").alias("community"))
            return members.join(names, "v").select("id", "community")


def local_moves(group: pd.DataFrame, total: float) -> pd.DataFrame:
    """(id, community) of one component (a, b, weight)."""
    near: dict[int, dict[int, float]] = {}
    for a, b, w in zip(group["a"].tolist(), group["b"].tolist(), group["weight"].tolist()):
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    belongs = {v: v for v in near}
    while True:
        # one level: vertices move between communities, then communities become vertices
        level: dict[int, dict[int, float]] = {}
        for v, out in near.items():
            for u, w in out.items():
                x = level.setdefault(belongs[v], {})
                x[belongs[u]] = x.get(belongs[u], 0.0) + w
        degree = {v: sum(out.values()) for v, out in level.items()}
        at, weight, any_moved = {v: v for v in level}, dict(degree), False
        again = True
        while again:
            again = False
            for v in sorted(level):
                weight[at[v]] -= degree[v]
                to: dict[int, float] = {}
                for u, w in level[v].items():
                    if u != v:
                        to[at[u]] = to.get(at[u], 0.0) + w
                gain = lambda c: to.get(c, 0.0) - weight[c] * degree[v] / (2 * total)  # noqa: E731, B023
                best = max(sorted(to), key=gain, default=at[v])
                if best != at[v] and gain(best) > gain(at[v]) + 1e-12:
                    at[v], again, any_moved = best, True, True
                weight[at[v]] += degree[v]
        if not any_moved:
            break
        belongs = {v: at[c] for v, c in belongs.items()}
    names: dict[int, int] = {}
    for v in sorted(belongs):
        names.setdefault(belongs[v], v)
    return pd.DataFrame({"id": list(belongs), "community": [names[c] for c in belongs.values()]})


def clusters(members: DataFrame, paragraphs: DataFrame, threshold: float, kind: str = "content") -> DataFrame:
    """One row per cluster of (id, cluster_id): its name from its first paragraph, its size and its documents."""
    rows = members.join(paragraphs.select("id", "content", "document_id"), "id")
    per_document = rows.groupBy("cluster_id", "document_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("content", "id").alias("content"), F.min("id").alias("first"))
    out = per_document.groupBy("cluster_id").agg(F.sum("n").alias("paragraphs"), F.count("document_id").alias("documents"), F.min_by("content", "first").alias("content"))
    return out.select("cluster_id", F.concat(F.lit("Cluster "), C("cluster_id").cast("string"), F.lit(": "), F.substring("content", 1, 50), F.lit("...")).alias("name"),
                      F.concat(F.lit("Group of "), C("paragraphs").cast("string"), F.lit(f" paragraphs with {kind} similarity")).alias("description"), "paragraphs", "documents", F.lit(threshold).alias("similarity_threshold"))
