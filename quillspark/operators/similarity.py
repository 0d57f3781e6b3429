"""Exact matches, set similarity joins, MinHash candidates and scores of pairs of paragraphs."""

from __future__ import annotations

import difflib
import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, drop_cut, mapped, ship
from .paragraphs import digest

#: Permutations of a signature; bands and rows of candidates, the split that suits a threshold of 0.7.
PERMUTATIONS, BANDS, ROWS = 128, 14, 9
#: Shorter contents take no part in near matches.
MIN_LENGTH = 10
#: Thresholds by the score they are compared with.
DEFAULT_THRESHOLDS = {"content": 0.8, "text": 0.85}
#: Counters for the frequency of items, and what stands for the rarity of an item of one set.
SLOTS, ALONE = 1 << 20, 255
#: Sets that may hold the items of a value by chance, as a power of two.
CHANCE_BITS = 10
#: Items that a value stands for at most: (sizes of the smaller set from, to below, items). A set of n items has about a
#: fifth of them to choose from at 0.8, so the number is less for longer sets.
MOST_ITEMS = ((1, 96, 3), (96, 512, 2), (512, 1 << 31, 1))

_U = np.uint64


def exact_classes(paragraphs: DataFrame) -> DataFrame:
    """(id, class_id, copies, links) of every paragraph whose key occurs in two or more documents: the smallest id of
    the class, its size, and the number of its members in other documents. Rows without content, key or document have
    none. The pairs of a class are its members of different documents; they are not written out, since their number is
    the square of the class. Counts per document come first, so no class gathers in one task."""
    keyed = paragraphs.filter("document_id is not null").select("id", "document_id", T.exact_key("content").alias("key")).filter("key <> ''")
    # the key is worked out once; what is counted and joined is its digest
    return _exact(cut(keyed.select("id", "document_id", digest("key").alias("h")), "exact-keys"))


def _exact(rows: DataFrame) -> DataFrame:
    """:func:`exact_classes` of rows (id, document_id, h) with the digests of their keys."""
    per_document = rows.groupBy("h", "document_id").agg(F.count(F.lit(1)).alias("own"), F.min("id").alias("low"))
    classes = per_document.groupBy("h").agg(F.sum("own").alias("copies"), F.min("low").alias("class_id"), F.count(F.lit(1)).alias("documents")).filter("documents > 1").drop("documents")
    return rows.join(per_document.drop("low"), ["h", "document_id"]).join(classes, "h").select("id", "class_id", "copies", (F.col("copies") - F.col("own")).alias("links"))


def _usable(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.filter(F.col("content").isNotNull() & F.col("document_id").isNotNull() & (F.length("content") >= MIN_LENGTH))


def representatives(paragraphs: DataFrame) -> DataFrame:
    """(id, first_document, last_document): each distinct content of MIN_LENGTH characters or more as its smallest id,
    with the least and greatest id of its documents."""
    return _usable(paragraphs).groupBy(digest("content").alias("h")).agg(F.min("id").alias("id"), F.min("document_id").alias("first_document"), F.max("document_id").alias("last_document")).drop("h")


def distinct_contents(paragraphs: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """:func:`representatives`, or those given, with their content."""
    reps = representatives(paragraphs) if of is None else of
    # a row that is repeated has one content
    return reps.join(_usable(paragraphs).select("id", "content").join(reps.select("id"), "id", "left_semi").dropDuplicates(["id"]), "id")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits (a published finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hashes(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of a column of lists one after another, where each list starts, and how long it is."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return _mix(column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)), offsets[:-1] - offsets[0], np.diff(offsets)


def _rarity(sets: DataFrame) -> tuple[np.ndarray, int]:
    """How rare items are, by counter, and the number of sets: quarter bits by which fewer sets (items: hashes) hold one than there are, ALONE
    if it is in one set. The number of counters is fixed, and so is what comes to the driver; items that share a
    counter seem less rare."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            held = _hashes(batch.column(0))[0]
            total[:SLOTS] += np.bincount((held >> _U(44)).astype(np.int64), minlength=SLOTS)
            total[SLOTS] += batch.num_rows
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], ["slot", "f"])

    counts = mapped(sets.select("h"), count, "slot int, f long").groupBy("slot").agg(F.sum("f").alias("f")).toArrow()
    total = np.zeros(SLOTS + 1, np.int64)
    total[counts.column("slot").to_numpy()] = counts.column("f").to_numpy()
    bits = np.log2(max(1, total[SLOTS]) / np.maximum(total[:SLOTS], 1))
    return np.where(total[:SLOTS] == 1, ALONE, np.clip(np.round(bits * 4), 0, ALONE - 1)).astype(np.uint8), max(1, int(total[SLOTS]))


def _first_shared(h: np.ndarray, starts: np.ndarray, n: np.ndarray, rarity: np.ndarray, enough: int, threshold: float) -> tuple[np.ndarray, ...]:
    """(set number, value, skipped): for each set the values that stand for what may be the first items, rarest first,
    that it shares with a set similar enough, and how many of its own items come before these without being shared.

    A value stands for as many items as it takes until few sets should hold them all by chance (``enough`` quarter
    bits), at most as MOST_ITEMS says, no more than are shared for certain. Where it ends depends on the items, so that
    both sets of a pair have the value in common. An item of one set only is never shared."""
    owner = np.repeat(np.arange(len(n)), n)
    rare = rarity[(h >> _U(44)).astype(np.int64)].astype(np.int64)
    order = np.lexsort((h, -rare, owner))
    h, rare = h[order], rare[order]
    need = np.ceil(n * threshold - 1e-9).astype(np.int64)
    owners, values, skips = [], [], []
    for low, high, most in MOST_ITEMS:
        # the smaller set of a pair tells which of these holds
        s = np.flatnonzero((n >= low) & (n * threshold < high + 1e-9))
        length = n[s] - need[s] + 1
        s = np.repeat(s, length)
        at = np.arange(len(s)) - np.repeat(np.cumsum(length) - length, length)
        value, bits, depth = np.full(len(s), most, np.uint64), np.zeros(len(s), np.int64), 1
        while len(s):
            shared = rare[starts[s] + at] != ALONE
            s, at, value, bits = s[shared], at[shared], value[shared], bits[shared]
            value, bits = _mix(value + h[starts[s] + at]), bits + rare[starts[s] + at]
            done = (bits >= enough) | (depth >= most)
            out = done | (depth >= need[s])
            owners.append(s[out])
            values.append(value[out])
            skips.append(at[out] - (depth - 1))
            s, at, value, bits = s[~done], at[~done], value[~done], bits[~done]
            more = np.clip(n[s] - need[s] + depth - at, 0, n[s] - 1 - at)
            step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            s, at, value, bits = (np.repeat(x, more) for x in (s, at, value, bits))
            at = at + 1 + step
            depth += 1
    return np.concatenate(owners), np.concatenate(values), np.concatenate(skips)


def prefix_join(a: DataFrame, b: DataFrame | None, threshold: float) -> DataFrame:
    """(id_a, id_b, score): pairs whose sets share ``threshold`` of their union or more, exactly.

    ``a`` and ``b`` have columns id and items (arrays of distinct strings without line ends); without ``b`` it is a self-join with
    id_a < id_b. Empty sets match nothing. Two such sets share one of their rarest n - ceil(t n) + 1 items. If that is
    a common one, the next item they share is put to it, as :func:`_first_shared` says, so that few sets meet by chance.
    Where they meet, sizes, the items skipped so far and 64 bits of parity, of which no more differ than items, drop
    most pairs; the items themselves decide.
    """
    sides = [a.select("id", "items").filter(F.size("items") > 0)] + ([b.select("id", "items").filter(F.size("items") > 0)] if b is not None else [])
    hashed = [x.select("id", F.transform("items", lambda w: F.xxhash64(w)).alias("h")) for x in sides]
    rarity, sets = _rarity(reduce(DataFrame.unionByName, [x.select("h") for x in hashed]))
    enough = max(0, round(4 * np.log2(sets)) - 4 * CHANCE_BITS)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h, starts, n = _hashes(batch.column(1))
                odd = np.bitwise_xor.reduceat(_U(1) << (_mix(h ^ _U(0x5DEECE66D)) & _U(63)), starts).view(np.int64)
                owner, value, skip = _first_shared(h, starts, n, rarity, enough, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column(0).take(pa.array(owner)), pa.array(odd[owner]), pa.array(n[owner].astype(np.int32)), pa.array(skip.astype(np.int32))], ["v", "id", "odd", "n", "skip"])

    # a self-join deals its sets once
    dealt = [cut(mapped(x, deal, f"v long, id {x.schema['id'].dataType.simpleString()}, odd long, n int, skip int"), "first-shared") for x in hashed]
    left, right = (rows.select(*[F.col(c).alias(f"{c}_{x}") for c in ("v", "id", "odd", "n", "skip")]) for rows, x in ((dealt[0], "a"), (dealt[-1], "b")))
    total = F.col("n_a") + F.col("n_b")
    shared = F.ceil(total * (threshold / (1 + threshold)) - 1e-9)
    # the cheap tests, which drop most, come first
    apart = F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= total * ((1 - threshold) / (1 + threshold)) + 1e-6
    near = apart & (shared <= F.least(F.col("n_a") - F.col("skip_a"), F.col("n_b") - F.col("skip_b")))
    pairs = left.join(right, (F.col("v_a") == F.col("v_b")) & (F.col("id_a") < F.col("id_b") if b is None else F.lit(True)) & near).select("id_a", "id_b").distinct()
    pairs = cut(pairs, "pairs-that-met")
    for rows in dealt:
        drop_cut(rows)

    def those(rows: DataFrame, ids: DataFrame) -> DataFrame:
        # a list as one string is a third of its size in the exchange
        return cut(rows.select("id", F.array_join("items", "\n").alias("items")).join(ids.distinct(), "id", "left_semi"), "sets-that-met")

    ends = [pairs.select(F.col(f"id_{x}").alias("id")) for x in "ab"]
    held = [those(sides[0], ends[0].unionByName(ends[1]))] * 2 if b is None else [those(rows, ids) for rows, ids in zip(sides, ends)]
    side = lambda x: held["ab".index(x)].select(F.col("id").alias(f"id_{x}"), F.split("items", "\n").alias(f"items_{x}"))
    scored = pairs.join(side("a"), "id_a").join(side("b"), "id_b").select("id_a", "id_b", T.jaccard(F.col("items_a"), F.col("items_b")).alias("score"))
    return scored.filter(F.col("score") >= threshold)


class _Words(dict):
    """What stands between blanks in lower-case text, without what is neither letter, number nor underscore ("" for
    stopwords), and without the punctuation that keys leave out; kept as long as they are few."""

    def __missing__(self, raw: str) -> tuple[str, str]:
        if len(self) > 300_000:
            self.clear()
        word = raw if raw.isascii() and raw.isalnum() else "".join(c for c in raw if c == "_" or unicodedata.category(c)[0] in "LN")
        got = self[raw] = "" if word in _STOP else word, raw.translate(_NO_PUNCTUATION)
        return got


_STOP = frozenset(T.STOPWORDS)
_NO_PUNCTUATION = str.maketrans("", "", ",.;:!?\"'()[]")


def _short(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()[:16]


def _worded(paragraphs: DataFrame) -> DataFrame:
    """(id, document_id, key, h, s, words) of rows that have a document and a content: digests of the key of exact
    matches (null for an empty key), of the content and of its words; and its different words without stopwords in order.
    All but the key are null where a content takes no part in near matches. Texts are read once for all of these, in
    Python, where what is looked up by word costs a fraction of the regular expressions of :mod:`..functions.text`."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            keys, held, sets = [], [], []
            for text, long in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                told = list(map(known.__getitem__, text.split()))
                key = " ".join([x[1] for x in told]).strip(" ")
                keys.append(_short(key) if key else None)
                words = {x[0] for x in told} - {""} if long else None
                held.append(" ".join(sorted(words)) if words else None)
                sets.append(_short(held[-1]) if words else None)
            words = pa.array(held, pa.string())
            h = pc.if_else(words.is_valid(), batch.column(2), pa.scalar(None, batch.schema.field(2).type))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), h, pa.array(sets, pa.binary()), words], names)

    names = ["id", "document_id", "key", "h", "s", "words"]
    rows = paragraphs.filter("document_id is not null and content is not null").select("id", "document_id", digest("content").alias("h"), F.lower("content").alias("text"), (F.length("content") >= MIN_LENGTH).alias("long"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "document_id")]
    return mapped(rows, lambda batches: read(x.select(["id", "document_id", "h", "text", "long"]) for x in batches), f"id {kinds[0]}, document_id {kinds[1]}, key binary, h binary, s binary, words string")


def _similar(rows: DataFrame, threshold: float) -> DataFrame:
    """:func:`similar_classes` of a cut table of :func:`_worded` rows, which is deleted when it is read. Equal sets of
    words are one, named by the smallest id, until the pairs are told."""
    used = rows.filter("words is not null")
    reps = cut(used.groupBy("h").agg(F.min("id").alias("id"), F.min("document_id").alias("first"), F.max("document_id").alias("last"), F.first("key").alias("key"), F.first("s").alias("s")).drop("h"), "representatives")
    classes = cut(reps.groupBy("s").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("members")), "word-sets")
    sets = cut(used.select("id", "words", "s").join(classes.select("id", "s"), ["id", "s"], "left_semi").dropDuplicates(["id", "s"]).select("id", F.split("words", " ").alias("items")), "sets")
    drop_cut(rows)
    alike = cut(prefix_join(sets, None, threshold).unionByName(classes.filter("members > 1").select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("score"))), "similar-sets")
    drop_cut(sets)
    members = cut(reps.join(classes.select("s", F.col("id").alias("class")), "s").drop("s"), "members")
    drop_cut(reps)
    side = lambda x: members.select(F.col("class").alias(f"id_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("first", "last", "key")], F.col("id").alias(x))
    pairs = alike.join(side("a"), "id_a").join(side("b"), "id_b").filter(_apart() & ~F.col("key_a").eqNullSafe(F.col("key_b")) & ((F.col("id_a") != F.col("id_b")) | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), F.col("score").alias("content_score"))


def similar_classes(paragraphs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b, content_score): representatives of distinct contents that share ``threshold`` of their words
    without stopwords, have different keys of exact matches, and lie in different documents. Copies of a content are
    one representative; :func:`distinct_contents` tells its documents."""
    # words and keys are worked out once; what is joined is small
    return _similar(cut(_worded(paragraphs.filter(F.length("content") >= MIN_LENGTH)), "worded"), threshold)


def signatures(contents: DataFrame) -> DataFrame:
    """(id, signature, bands): MinHash of word pairs for contents over 100 characters, else of character shingles; null
    for contents without any."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat(F.element_at("words", i), F.lit(" "), F.element_at("words", i + 1)))
    held = contents.select("id", "content", T.tokens("content").alias("words"), T.cleaned("content").alias("cleaned")).select(
        "id", F.when(F.length("content") <= 100, T.shingles("cleaned")).when(F.size("words") > 1, pairs).otherwise(F.array().cast("array<string>")).alias("items"))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(1)
        multiply, add = rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
        for batch in batches:
            out = []
            for items in batch.column(1).to_pylist():
                if items:
                    h = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in set(items)), np.uint64)
                    out.append(((h[:, None] * multiply + add) >> np.uint64(33)).min(0).astype(np.int32))
                else:
                    out.append(None)
            bands = [None if s is None else [xxhash.xxh3_64_intdigest(s[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k) - (1 << 63) for k in range(BANDS)] for s in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32())), pa.array(bands, pa.list_(pa.int64()))], ["id", "signature", "bands"])

    return mapped(held, sign, "id long, signature array<int>, bands array<long>")


def lsh_pairs(paragraphs: DataFrame, threshold: float = 0.8, hot: int = 1000) -> DataFrame:
    """(id_a, id_b, estimate): representatives of distinct contents in different documents that share a band and whose
    signatures agree in ``threshold`` of their places. Candidates are found across the whole table; contents without
    items, which would all agree, are candidates of none. Equal signatures take part once, as their smallest id: their
    classes are told by :func:`signature_classes`, so a band holds different signatures only. The members of a band with
    more than ``hot`` are dealt into blocks, and each pair of blocks is joined in a task of its own."""
    reps = cut(representatives(paragraphs), "representatives")
    signed = cut(signatures(distinct_contents(paragraphs, reps)).filter("signature is not null").select("id", "signature", "bands", digest_of("signature").alias("s")), "signatures")
    # a class lies in the documents of all its contents
    least = cut(signed.select("s", "id").join(reps.select("id", "first_document", "last_document"), "id").groupBy("s").agg(
        F.min("id").alias("id"), F.min("first_document").alias("first_document"), F.max("last_document").alias("last_document")), "signature-documents")
    bands = cut(signed.join(least, ["s", "id"], "left_semi").select(F.explode("bands").alias("v"), "id"), "bands")
    sizes = bands.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("v", F.ceil(F.col("n") / hot).cast("int").alias("blocks"))
    dealt = bands.join(sizes, "v").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # the pair of blocks (x, y), x <= y, meets block x as its left side and y as its right side
    left = dealt.select("v", F.col("id").alias("l"), F.col("block").alias("x"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("y"))
    right = dealt.select("v", F.col("id").alias("r"), F.col("block").alias("y"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("x"))
    met = left.join(right, ["v", "x", "y"]).filter("x < y or l < r")
    pairs = met.select(F.least("l", "r").alias("id_a"), F.greatest("l", "r").alias("id_b")).distinct()
    side = lambda x: signed.select(F.col("id").alias(f"id_{x}"), F.col("signature").alias(f"s_{x}")).join(
        least.select(F.col("id").alias(f"id_{x}"), F.col("first_document").alias(f"first_{x}"), F.col("last_document").alias(f"last_{x}")), f"id_{x}")
    same = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda t, x: t + x) / PERMUTATIONS
    return pairs.join(side("a"), "id_a").join(side("b"), "id_b").filter(_apart()).select("id_a", "id_b", same.alias("estimate")).filter(F.col("estimate") >= threshold)


def digest_of(column: str) -> Column:
    """128 bits that stand for an array of integers."""
    return F.unhex(F.substring(F.sha2(F.array_join(F.col(column), ","), 256), 1, 32))


def signature_classes(paragraphs: DataFrame) -> DataFrame:
    """(id, class_id): representatives of distinct contents whose signatures are equal, with the smallest id of these.
    Contents without items are in no class."""
    signed = cut(signatures(distinct_contents(paragraphs)).filter("signature is not null").select("id", digest_of("signature").alias("s")), "signature-classes")
    classes = signed.groupBy("s").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return signed.join(classes, "s").select("id", "class_id")


def _apart() -> Column:
    """Whether the contents of a pair don't lie in one and the same document only."""
    return ~((F.col("first_a") == F.col("last_a")) & (F.col("first_b") == F.col("last_b")) & (F.col("first_a") == F.col("first_b")))


def chunked_score(a: Column, b: Column) -> Column:
    """How much of the shorter text, in overlapping chunks, stands in the longer one, at most 1; null if the shorter one
    is under 40 characters."""
    la, lb = F.length(a), F.length(b)
    short, long = F.when(la <= lb, a).otherwise(b), F.when(la <= lb, b).otherwise(a)
    n = F.least(la, lb)
    size = F.least(F.lit(100), F.floor(n / 2)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n - 1, F.greatest(F.floor(size / 2), F.lit(1)).cast("int")), lambda k: F.substring(short, k + 1, size))
    found = F.aggregate(F.filter(chunks, lambda c: (F.length(c) >= 20) & long.contains(c)), F.lit(0), lambda t, c: t + F.length(c))
    return F.when(size >= 20, F.least(found / n, F.lit(1.0)))


def _ratio(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")


def text_scores(pairs: DataFrame, a: str = "content1", b: str = "content2") -> DataFrame:
    """``pairs`` with ``text_score``, the character similarity of two texts in lower case: the ratio of lengths if one
    contains the other, chunk overlap if one has over 1000 characters, else the matching ratio of the first against the
    second. A null or blank text scores 0.

    Only the last reaches Python, each different pair of texts once, so that its cost is bounded by pairs of 1000
    characters; a text of under 40 beside a longer one than 1000 is matched too, in time proportional to that."""
    ship(pairs.sparkSession)
    low_a, low_b = F.lower(F.trim(F.col(a))), F.lower(F.trim(F.col(b)))
    rows = pairs.withColumn("__a", low_a).withColumn("__b", low_b)
    x, y = F.col("__a"), F.col("__b")
    la, lb = F.length(x), F.length(y)
    native = F.when((la == 0) | (lb == 0) | x.isNull() | y.isNull(), 0.0).when(x.contains(y) | y.contains(x), F.least(la, lb) / F.greatest(la, lb)).when(F.greatest(la, lb) > 1000, chunked_score(x, y))
    held = cut(rows.withColumn("text_score", native).withColumn("__pair", F.when(F.col("text_score").isNull(), F.xxhash64("__a", "__b"))), "text-scores")
    ratio = F.pandas_udf(_ratio, "double")
    matched = held.filter("text_score is null").select("__a", "__b", "__pair").dropDuplicates(["__pair", "__a", "__b"]).repartition("__pair").select("__pair", "__a", "__b", ratio("__a", "__b").alias("__ratio"))
    joined = held.join(matched, ["__pair", "__a", "__b"], "left")
    return joined.select(*[F.col(c) for c in pairs.columns], F.coalesce("text_score", "__ratio").alias("text_score"))


def equal_share(x: str, y: str) -> float:
    """Percent of what two texts hold together that is equal, by matching blocks: of characters up to 1000 of them, of
    words with the blanks after them in longer texts."""
    if max(len(x), len(y)) > 1000:
        x, y = (re.findall(r"\S*\s*", t)[:-1] for t in (x, y))
        weigh = lambda part: sum(map(len, part))
    else:
        weigh = len
    same = sum(weigh(x[m.a : m.a + m.size]) for m in difflib.SequenceMatcher(None, x, y, False).get_matching_blocks())
    return round(100.0 * same / max(1, weigh(x) + weigh(y) - same), 1)


def differences(members: DataFrame) -> DataFrame:
    """(cluster_id, id, equal_percent, bucket) of cluster members (cluster_id, id, content): how much of each equals the
    cluster's first paragraph; high beyond 80, medium beyond 50, else low. Null contents count as empty. A content is
    compared once in a cluster, however often it stands there."""
    ship(members.sparkSession)
    rows = cut(members.select("cluster_id", "id", F.coalesce("content", F.lit("")).alias("content"), digest("content").alias("h")), "members")
    first = rows.groupBy("cluster_id").agg(F.min_by("content", "id").alias("first"))
    share = F.pandas_udf(lambda a, b: pd.Series([equal_share(x, y) for x, y in zip(a, b)], dtype="float64"), "double")
    compared = rows.dropDuplicates(["cluster_id", "h"]).select("cluster_id", "h", "content").join(first, "cluster_id").select("cluster_id", "h", share("first", "content").alias("equal_percent"))
    out = rows.select("cluster_id", "id", F.coalesce("h", F.lit(b"")).alias("k")).join(compared.select("cluster_id", F.coalesce("h", F.lit(b"")).alias("k"), "equal_percent"), ["cluster_id", "k"])
    return out.select("cluster_id", "id", "equal_percent", F.when(F.col("equal_percent") > 80, "high").when(F.col("equal_percent") > 50, "medium").otherwise("low").alias("bucket"))


class _Scorer:
    """Text scores, those of pairs with one and the same second text in a row faster: what the matcher knows of that text is
    kept. Texts are in lower case without blanks at the ends."""

    def __init__(self) -> None:
        self.second, self.known, self.letters = None, {}, {}

    def __call__(self, x: str, y: str) -> float:
        if not x or not y:
            return 0.0
        if x in y or y in x:
            return min(len(x), len(y)) / max(len(x), len(y))
        if max(len(x), len(y)) > 1000:
            short, long = (x, y) if len(x) <= len(y) else (y, x)
            size = min(100, len(short) // 2)
            if size >= 20:
                chunks = (short[k : k + size] for k in range(0, len(short), size // 2))
                return min(sum(len(c) for c in chunks if len(c) >= 20 and c in long) / len(short), 1.0)
        if y != self.second:
            self.second, self.known = y, difflib.SequenceMatcher(None, "", y).b2j
        letters = self.letters.get(x)
        if letters is None:
            if len(self.letters) > 20_000:
                self.letters.clear()
            letters = self.letters[x] = frozenset(x)
        return 2.0 * _matching(x, y, self.known, [c for c in letters if c in self.known]) / (len(x) + len(y))


def _matching(x: str, y: str, known: dict[str, list[int]], shared: list[str]) -> int:
    """How many characters difflib's matching blocks hold, with what it knows of the second text (the places of its characters
    but for very frequent ones) and which of these characters the first text has. Only their places are looked at."""
    if len(shared) > 8:
        at = [i for i, c in enumerate(x) if c in known]
    else:
        at = []
        for c in shared:
            i = x.find(c)
            while i >= 0:
                at.append(i)
                i = x.find(c, i + 1)
        at.sort()
    same, queue = 0, [(0, len(x), 0, len(y))]
    while queue:
        alo, ahi, blo, bhi = queue.pop()
        besti, bestj, size, last, lengths = alo, blo, 0, -2, {}
        for i in at[bisect_left(at, alo) : bisect_left(at, ahi)]:
            if i != last + 1:
                lengths = {}
            last, here = i, {}
            for j in known[x[i]]:
                if j < blo:
                    continue
                if j >= bhi:
                    break
                k = here[j] = lengths.get(j - 1, 0) + 1
                if k > size:
                    besti, bestj, size = i - k + 1, j - k + 1, k
            lengths = here
        while besti > alo and bestj > blo and x[besti - 1] == y[bestj - 1]:
            besti, bestj, size = besti - 1, bestj - 1, size + 1
        while besti + size < ahi and bestj + size < bhi and x[besti + size] == y[bestj + size]:
            size += 1
        if size:
            same += size
            if alo < besti and blo < bestj:
                queue.append((alo, besti, blo, bestj))
            if besti + size < ahi and bestj + size < bhi:
                queue.append((besti + size, ahi, bestj + size, bhi))
    return same


def _pair_scores(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (id_a, id_b, content_score) with ``text_score`` of their texts (id, text), as :func:`text_scores` has it.
    Texts meet their pairs in the order of the first and then of the second, so a text of many pairs goes through the exchange
    packed, and is taken apart once."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer()
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column(1).to_numpy(), kind="stable")))
            scores = [scorer(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.float64())], ["id_a", "id_b", "content_score", "text_score"])

    side = lambda x: texts.select(F.col("id").alias(f"id_{x}"), F.col("text").alias(x))
    met = pairs.join(side("a"), "id_a").join(side("b"), "id_b").select("id_a", "id_b", "content_score", "a", "b")
    return mapped(met, score, "id_a long, id_b long, content_score double, text_score double")


def full_search(paragraphs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b, content_score, text_score, kind): the whole search. Exact matches, each member of a class against
    its smallest id with scores of 1; then pairs of representatives of different contents by words, as
    :func:`similar_classes` has them, with their text score, 0.01 at least. Nothing for fewer than two usable rows."""
    rows = cut(_worded(paragraphs), "worded")
    keys = cut(rows.filter("key is not null").select("id", "document_id", F.col("key").alias("h")), "exact-keys")
    exact = _exact(keys).filter("id <> class_id").select(F.col("class_id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("content_score"), F.lit(1.0).alias("text_score"), F.lit("exact").alias("kind"))
    pairs = cut(_similar(rows, threshold), "similar-pairs")
    ends = pairs.select(F.col("id_a").alias("id")).distinct().unionByName(pairs.select(F.col("id_b").alias("id")).distinct())
    texts = cut(paragraphs.filter("document_id is not null and content is not null").join(ends.distinct(), "id", "left_semi").dropDuplicates(["id"]).select("id", F.lower(F.trim("content")).alias("text")), "texts")
    similar = _pair_scores(pairs, texts).select("id_a", "id_b", "content_score", F.greatest("text_score", F.lit(0.01)).alias("text_score"), F.lit("similar").alias("kind"))
    return exact.unionByName(similar)
