"""Sources mixed to target shares of tokens (problem 9), by a min-cost flow over membership patterns."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut, drop_cut, mapped, spread, table

#: The rank file of a public tokenizer; it is read by the driver and travels with the tasks.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of that file.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Buckets of the seeded order of a pattern's texts, each ordered on its own.
BUCKETS = 4096
SEED = 17
#: So many documents of one source and text are paired with those of other sources at a time.
SPREAD = 100_000


def token_counts(documents: DataFrame, ranks_file: str = RANKS) -> DataFrame:
    """(doc_id, source, digest, tokens) of every document: a 128-bit digest of its text, and the text's number of
    tokens. Null texts count as empty."""
    ranks = documents.sparkSession.sparkContext.broadcast(Path(ranks_file).read_bytes())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        encoding = tiktoken.Encoding("mix", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in texts], pa.binary()),
                pa.array([len(encoding.encode_ordinary(x)) for x in texts], pa.int64())], ["doc_id", "source", "digest", "tokens"])

    return mapped(spread(documents.select(F.col("doc_id").cast("long"), "source", "text")), count, "doc_id long, source string, digest binary, tokens long")


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], start: int, end: int) -> list[int]:
    """The flow on each edge (from, to, capacity, cost) of a maximal flow of least cost, by successive shortest paths
    with potentials. Costs are not negative."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, left, cost = [], [], []
    for a, b, capacity, c in edges:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to += [b, a]
        left += [capacity, 0]
        cost += [c, -c]
    potential = [0] * n
    while True:
        distance: list[float] = [float("inf")] * n
        via = [-1] * n
        distance[start] = 0
        heap = [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a]:
                continue
            for k in graph[a]:
                if left[k] and (x := d + cost[k] + potential[a] - potential[to[k]]) < distance[to[k]]:
                    distance[to[k]], via[to[k]] = x, k
                    heapq.heappush(heap, (x, to[k]))
        if via[end] < 0:
            return [left[2 * k + 1] for k in range(len(edges))]
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, distance)]
        push, at = float("inf"), end
        while at != start:
            push, at = min(push, left[via[at]]), to[via[at] ^ 1]
        at = end
        while at != start:
            left[via[at]] -= push
            left[via[at] ^ 1] += push
            at = to[via[at] ^ 1]


def routed(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> tuple[dict, bool]:
    """Tokens that each pattern gives to each of its sources for a set of ``total`` tokens, and whether every source's
    quota is met. The r-th use of a text costs r - 1, so texts are repeated evenly and only where needed; a source uses
    no text more often than it may."""
    sources = sorted(targets)
    node = {s: 2 + len(patterns) + k for k, s in enumerate(sources)}
    whole = sum(share for share, _ in targets.values())
    quota = {s: round(total * targets[s][0] / whole) for s in sources}
    edges, ways = [], []
    for k, (pattern, tokens) in enumerate(sorted(patterns.items())):
        for use in range(max(targets[s][1] for s in pattern)):
            edges.append((0, 2 + k, tokens, use))
        for s in pattern:
            ways.append((len(edges), pattern, s))
            edges.append((2 + k, node[s], tokens * targets[s][1], 0))
    ends = {s: len(edges) + k for k, s in enumerate(sources)}
    edges += [(node[s], 1, quota[s], 0) for s in sources]
    flow = min_cost_flow(2 + len(patterns) + len(sources), edges, 0, 1)
    return {(p, s): flow[k] for k, p, s in ways if flow[k]}, all(flow[ends[s]] == quota[s] for s in sources)


def planned(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]) -> dict:
    """The routing of the largest set whose quotas can all be met, found by bisection over its total tokens."""
    low, high = 0, sum(t * max(targets[s][1] for s in p) for p, t in patterns.items()) if patterns else 0
    best: dict = {}
    while low < high:
        middle = (low + high + 1) // 2
        plan, met = routed(patterns, targets, middle)
        if met:
            low, best = middle, plan
        else:
            high = middle - 1
    return best


def _targets(mix: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and repeat cap by source; the table is one row per source, so the driver may hold it."""
    rows = mix.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).collect()
    return {r.source: (r.w, r.r) for r in rows}


def units(counted: DataFrame, once: bool = False) -> DataFrame:
    """(unit, source, doc_id, tokens): every document in one unit, which the sources that hold its text share.

    The k-th documents of one text in each source are one unit, so a text that a source holds three times and another
    once makes one unit of both sources and two of the first. With ``once`` further documents of a text in a source
    stay out. Documents of a text that fills a source are numbered in parts of about SPREAD, so none gathers in a task."""
    many = counted.groupBy("digest", "source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).filter("n > 1")
    held = counted.join(many, ["digest", "source"], "left")
    if once:
        return held.filter("least is null or doc_id = least").select(F.col("digest").alias("unit"), "source", "doc_id", "tokens")
    single = held.filter("n is null").select(F.col("digest").alias("unit"), "source", "doc_id", "tokens")
    parts = F.floor(F.col("n") / SPREAD) + 1
    repeated = held.filter("n is not null").withColumn("part", F.when(F.col("doc_id") == F.col("least"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), parts)))
    place = F.row_number().over(Window.partitionBy("digest", "source", "part").orderBy("doc_id"))
    unit = F.when(F.col("part") < 0, F.col("digest")).otherwise(F.unhex(F.md5(F.concat(F.col("digest"), F.concat_ws(" ", "part", "k").cast("binary")))))
    return single.unionByName(repeated.withColumn("k", place).select(unit.alias("unit"), "source", "doc_id", "tokens"))


def mixed(documents: DataFrame, mix: DataFrame, ranks_file: str = RANKS, seed: int = SEED, once: bool = False) -> DataFrame:
    """(doc_id, source, tokens, copies): the training set, as the number of times each document is taken for a source.

    A text that documents of several sources hold belongs to all of them (its membership pattern), see :func:`units`;
    ``once`` leaves further documents of the same text and source out. Sources not listed in ``mix`` take no part; empty
    texts neither; a repeated row counts once. A listed source without tokens can't have a share, so the others share
    the whole. The set is the largest whose shares meet the targets, up to the size of one text per pattern and source.
    Equal seeds give equal sets.
    """
    spark = documents.sparkSession
    targets = _targets(mix)
    listed = documents.join(F.broadcast(spark.createDataFrame([(s,) for s in targets], "source string")), "source", "left_semi")
    counted = cut(token_counts(listed, ranks_file).filter("tokens > 0").dropDuplicates(["doc_id", "source"]), "tokens")
    held = cut(units(counted, once), "units")
    drop_cut(counted)
    texts = held.groupBy("unit").agg(F.array_join(F.array_sort(F.collect_set("source")), "\x1f").alias("pattern"), F.max("tokens").alias("tokens")).withColumnRenamed("unit", "digest")
    order = F.xxhash64(F.lit(seed), "digest")
    texts = cut(texts.select("digest", "pattern", "tokens", F.pmod(order, F.lit(BUCKETS)).cast("int").alias("bucket"), order.alias("at")), "texts")
    per_bucket = texts.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("held"))
    # at most BUCKETS rows per pattern of the sources
    before = per_bucket.select("pattern", "bucket", (F.sum("held").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("held")).alias("before"))
    sizes = {tuple(r.pattern.split("\x1f")): r.tokens for r in per_bucket.groupBy("pattern").agg(F.sum("held").alias("tokens")).collect()}
    present = {s for p in sizes for s in p}
    plan = planned(sizes, {s: t for s, t in targets.items() if s in present})
    # each source has a stretch of its pattern's line of uses; use k of a text at u is the point k + u
    stretches, done = [], {}
    for (pattern, source), tokens in sorted(plan.items()):
        begin = done.get(pattern, 0)
        done[pattern] = begin + tokens
        stretches.append(("\x1f".join(pattern), source, begin, begin + tokens, sizes[pattern]))
    line = F.broadcast(spark.createDataFrame(stretches, "pattern string, source string, begin long, end long, whole long"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("at", "digest")
    placed = texts.withColumn("u", F.sum("tokens").over(inside) - F.col("tokens")).join(before, ["pattern", "bucket"]).withColumn("u", F.col("u") + F.col("before"))
    uses = lambda edge: F.ceil((F.col(edge) - F.col("u")) / F.col("whole")).cast("long")
    chosen = placed.join(line, "pattern").select("digest", "source", (F.greatest(uses("end"), F.lit(0)) - F.greatest(uses("begin"), F.lit(0))).cast("int").alias("copies")).filter("copies > 0")
    return held.join(chosen.withColumnRenamed("digest", "unit"), ["unit", "source"]).select("doc_id", "source", "tokens", "copies")


def p9_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chosen document with its copies, and the share its source has of all tokens beside the target."""
    chosen = cut(mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")), "mixed")
    shares = _shares(chosen, table(spark, sf_dir, "mix_targets")).select("source", "target_share", "actual_share")
    return chosen.join(F.broadcast(shares), "source")


def _shares(chosen: DataFrame, mix: DataFrame) -> DataFrame:
    per_source = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    return mix.select("source", "target_share", "max_repeats").join(per_source, "source", "left").withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy())).select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source of the targets: the actual share of tokens beside the target, and the repetition needed."""
    mix = table(spark, sf_dir, "mix_targets")
    return _shares(mixed(table(spark, sf_dir, "documents"), mix), mix)


QUERIES = {"p9_training_set": p9_training_set, "p9_shares": p9_shares}
