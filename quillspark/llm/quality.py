"""Per-document text quality statistics and the verdict prose, list, table or junk (problem 10).

The statistics come from one pass over each whole text, split into words and lines once. The verdict is an ordered rule
list, induced from labelled documents by incremental reduced-error pruning and applied as one SQL CASE.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, mapped, spread, table
from .form import Form, PerToken, representatives, words

# Frequent function words of English, German and French.
COMMON_WORDS = """
the of and to in is a an for be by on that this with as at from or it its are was were has have been not if any each no shall will may most them into so
der die das des dem den und ist zu von mit auf für ein eine einer eines nicht wird wurde werden war sich als nach vor bei bis noch zum zur über unter ohne sobald
le la les l de du un une et est à en pour que qui par sur dans ne se il elle au aux pas ni si sera été selon avec sous dès avant soit ce cette ont plus
"""
#: Labelled documents to learn from; beyond these a seeded sample of so many is taken.
MOST_LABELS = 4000
#: The least (right - wrong) / covered of a rule on the pruning rows, and refused rules before a class is done.
KEEP, RETRIES = 0.5, 6


_COMMON = frozenset(COMMON_WORDS.split())
_LIST = re.compile(r"[ \t]*(?:[-–—*•·‣▪◦]|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.)])[ \t]+\S")
# cells between semicolons are short, as semicolons also end clauses; those between bars, tabs or wide gaps have any width
_SHORT_CELLS = re.compile(r"[^;]{0,40};[^;]{0,40};")
_GAP = re.compile(" {3,}")
_REPEATED = re.compile(r"\b(\w{2,})(?:\W{1,2}\1\b){3,}")
_LONG = re.compile(r"[A-Za-z0-9+/=]{30,}")
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}")
_ODD = re.compile(r"(?:[^\w\s.,;:!?()/'\"|%–•*\u0300-\u036f-]|_)(?:[^\w\n\u0300-\u036f]|_)*|[ÂÃâï\ufffd]+")


def is_row(line: str) -> bool:
    """Whether a line is a row of a table: cells between bars, or three cells and more between semicolons, tabs or wide
    gaps."""
    return ("|" in line or line.count("\t") > 1 or ";" in line and _SHORT_CELLS.match(line) is not None
            or "   " in line and line[:1] != " " and len(_GAP.findall(line)) > 1)


FEATURES = ["mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "mean_line_length", "list_share", "table_share", "junk_share",
            "repeated_share", "long_share", "consonant_share", "odd_share", "digit_share"]
_STATISTICS = ["n_chars", "n_words", "n_lines", *FEATURES]


def _pack(word: str) -> int:
    """Of a word, in 40 bits each: its length, its letters in runs of consonants, its digits, and whether it is common."""
    consonants = sum(map(len, _CONSONANTS.findall(word)))
    return ((len(word) << 40 | consonants) << 40 | sum(map(str.isdigit, word))) << 40 | (word in _COMMON)


_packed, _FIELD = PerToken(_pack), (1 << 40) - 1


@functools.cache
def _is_odd(char: str) -> bool:
    return _ODD.match(char) is not None


def measured(text: str, form: Form) -> tuple:
    """The statistics of one text, as named in _STATISTICS. Words are those of its consistent form, in Unicode."""
    n = max(len(text), 1)
    solid = text.split()
    run = words(form(text))
    n_words = max(len(run), 1)
    packed = sum(map(_packed.__getitem__, run))
    letters, consonants, digits, common = packed >> 120, (packed >> 80 & _FIELD) / n, packed >> 40 & _FIELD, packed & _FIELD
    n_lines = ended = listed = rows = 0
    for line in text.split("\n"):
        bare = line.rstrip()
        if not bare:
            continue
        n_lines += 1
        ended += (bare[-1] if bare[-1] not in _QUOTES else bare.rstrip(_QUOTES)[-1:]) in _ENDS
        if _LIST.match(line):
            listed += len(line)
        if is_row(line):
            rows += len(line)
    total = lambda found: sum(map(len, found)) / n
    # a word four times on end shows as three equal neighbours in a row
    twice = list(map(eq, run, run[1:]))
    repeated = total(m[0] for m in _REPEATED.finditer(text)) if sum(twice) > 2 and any(map(all, zip(twice, twice[1:], twice[2:]))) else 0.0
    long = total(_LONG.findall(text)) if solid and max(map(len, solid)) >= 30 else 0.0
    odd = total(_ODD.findall(text)) if any(map(_is_odd, set(text))) else 0.0
    size, lines = sum(map(len, solid)), max(n_lines, 1)
    return (len(text), len(run), n_lines, letters / n_words, max(size - letters, 0) / max(size, 1), ended / lines, common / n_words,
            len(text) / lines, listed / n, rows / n, min(repeated + long + consonants + odd, 1.0), repeated, long, consonants, odd, digits / n)


# What ends a line of prose.
_ENDS, _QUOTES = frozenset(".!?:;,…"), "\"'”’»)"


def statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_words, n_lines and FEATURES) of each document's whole text, by one pass over it; a null text
    counts as empty, and an empty text has zeros."""
    form = Form(representatives({}))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(measured(x or "", form) for x in batch.column(1).to_pylist()))) or [()] * len(_STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64() if k < 3 else pa.float64()) for k, c in enumerate(columns))], ["doc_id", *_STATISTICS])

    schema = "doc_id long, " + ", ".join(f"{x} {'long' if k < 3 else 'double'}" for k, x in enumerate(_STATISTICS))
    return mapped(spread(documents.select(F.col("doc_id").cast("long"), "text")), measure, schema)


Rule = tuple[str, list[tuple[str, str, float]]]


def _covers(rule: list, x: pd.DataFrame) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, op, value in rule:
        hit &= (x[name].to_numpy() >= value) if op == ">=" else (x[name].to_numpy() < value)
    return hit


def _grow(x: pd.DataFrame, positive: np.ndarray) -> list:
    """Conditions added one by one, each the one of highest information gain (FOIL), until no negative is covered."""
    rule: list = []
    hit = np.ones(len(x), bool)
    while (hit & ~positive).any():
        p, n = (hit & positive).sum(), (hit & ~positive).sum()
        before, found = math.log2(p / (p + n)), (1e-9, None)
        for name in FEATURES:
            v, y = x[name].to_numpy()[hit], positive[hit]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            ups, all_up = np.cumsum(y), y.sum()
            edges = np.flatnonzero(v[1:] > v[:-1])
            if not len(edges):
                continue
            below, below_p = edges + 1, ups[edges]
            for op, total, good in (("<", below, below_p), (">=", len(v) - below, all_up - below_p)):
                gain = np.where(good > 0, good * (np.log2(np.maximum(good, 1e-9) / total) - before), -1)
                k = int(gain.argmax())
                if gain[k] > found[0]:
                    found = gain[k], (name, op, float((v[edges[k]] + v[edges[k] + 1]) / 2))
        if found[1] is None:
            break
        rule.append(found[1])
        hit = _covers(rule, x)
    return rule


def _prune(rule: list, x: pd.DataFrame, positive: np.ndarray) -> tuple[list, float]:
    """The start of a rule that is best on the pruning rows, by (right - wrong) / covered; the shortest on a tie."""
    best: tuple[float, int] = (-2.0, 0)
    for k in range(1, len(rule) + 1):
        hit = _covers(rule[:k], x)
        p, n = (hit & positive).sum(), (hit & ~positive).sum()
        value = (p - n) / (p + n) if p + n else -1.0
        if value > best[0] + 1e-9:
            best = value, k
    return rule[: best[1]], best[0]


def induce(x: pd.DataFrame, kinds: np.ndarray, seed: int = 3) -> list[Rule]:
    """An ordered rule list by incremental reduced-error pruning. Classes come from the rarest on; for each, rules are
    grown on two thirds of the rows left and pruned on the rest, and kept if their value
    there is KEEP or more; a refused rule is followed by another split, up to RETRIES times in a class. The last, empty rule is the most frequent class. ``x`` holds FEATURES, ``kinds`` the labels."""
    rng = np.random.default_rng(seed)
    names, counts = np.unique(kinds, return_counts=True)
    order = names[np.argsort(counts, kind="stable")]
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    for kind in order[:-1]:
        refused = 0
        while refused < RETRIES and (left & (kinds == kind)).sum() >= 2:
            rows = np.flatnonzero(left)
            rows = rows[np.argsort(rng.random(len(rows)), kind="stable")]
            # both parts hold the class in equal shares
            rows = np.concatenate([rows[kinds[rows] == kind], rows[kinds[rows] != kind]])
            growing = np.arange(len(rows)) % 3 != 2
            g, p = rows[growing], rows[~growing]
            rule, value = _prune(_grow(x.iloc[g], kinds[g] == kind), x.iloc[p], kinds[p] == kind)
            covered = _covers(rule, x) & left
            if not rule or value < KEEP or not (covered & (kinds == kind)).any():
                refused += 1
                continue
            rules.append((str(kind), rule))
            left &= ~covered
    rules.append((str(order[-1]), []))
    return rules


def as_sql(rules: list[Rule]) -> str:
    """The rule list as one CASE expression over the statistics."""
    cases = " ".join(f"WHEN {' AND '.join(f'{n} {op} {v!r}D' for n, op, v in rule)} THEN '{kind}'" for kind, rule in rules if rule)
    return f"CASE {cases} ELSE '{rules[-1][0]}' END" if cases else f"'{rules[-1][0]}'"


def learned_rules(stats: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> list[Rule]:
    """Rules from the labelled documents, at most ``most`` of them by a seeded order. A document with several labels
    has the most frequent, the smallest name on a tie. Without labels everything is prose."""
    one = labels.filter("kind is not null").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(
        F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("label"))
    chosen = one.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most)
    rows = stats.join(chosen, "doc_id").select("doc_id", "label", *FEATURES).toPandas().sort_values("doc_id", ignore_index=True)
    if rows.empty:
        return [("prose", [])]
    return induce(rows[FEATURES], rows["label"].to_numpy())


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document, with its verdict ``kind``."""
    stats = cut(statistics(table(spark, sf_dir, "documents")), "quality")
    return stats.withColumn("kind", F.expr(as_sql(learned_rules(stats, table(spark, sf_dir, "doc_labels")))))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).filter("kind <> 'prose'").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return judged(spark, sf_dir)


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics}
