"""Contents that are lightly edited versions of one another (problem 4).

Every distinct set of words gets an odd sketch: its MinHash samples are folded into a bitmap by parity, so the number
of ones in the XOR of two sketches tells how many samples differ. Candidates come from bands that miss no pair: all
words are dealt to so many parts that, of the most words in which two sets of those sizes may differ, at most SPREAD
fall in some part, and each part gives codes of which one leaves out any SPREAD words. Sets that share 0.8 of their
union so agree in a band value for certain, however frequent their words are. Bitmaps of parity, whose XOR never has
more ones than words differ, drop most candidates where they meet; sketches drop what is clearly less similar, and the
words themselves decide the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, drop_cut, mapped, spread, table
from .form import Form, MemberCounter, representatives, words
from .copies import record
from .links import components

THRESHOLD = 0.8
MIN_LETTERS_DIGITS = 60
MIN_WORDS = 15
#: MinHash samples, and bits of the odd sketch they are folded into.
SAMPLES, BITS, BLOCK = 128, 256, 1024
#: Differing words that the codes of a part put up with, and the codes: nonzero vectors of SPREAD + 1 bits.
SPREAD = 2
CODES = range(1, 2 << SPREAD)
#: A code whose words are not rare enough for at most 2 ** SLACK sets to hold them all by chance is light: it gives one
#: value with each part of a second dealing, of one part more than words may differ.
SLACK = 12.0
#: Sets that meet in one band value beyond which the value is hot: its sets are cut into blocks of so many, and pairs
#: of blocks are spread over all tasks.
HOT = 8192
#: Bytes of a band value that are shuffled; values that agree in these by chance are dropped like other candidates.
VALUE_BYTES = 5
#: Counters for the frequency of words; their number is fixed, so the table has the same size whatever the corpus.
SLOTS, CHUNK = 1 << 20, 1 << 14

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits (a published finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def most_flips(threshold: float = THRESHOLD, sigmas: float = 5.0) -> int:
    """Ones in the XOR of two sketches beyond which sets are less similar than the threshold, but for a deviation of
    ``sigmas`` standard deviations, which covers the spread of the samples and that of the bits they fall on."""
    differ = SAMPLES * (1 - threshold)
    keep = (1 - 2 / BITS) ** (2 * differ)
    expected = BITS / 2 * (1 - keep)
    samples = math.sqrt(SAMPLES * threshold * (1 - threshold)) * 2 * keep
    return math.ceil(expected + sigmas * math.hypot(samples, math.sqrt(BITS * (1 - keep * keep)) / 2))


def similarity(flips: np.ndarray) -> np.ndarray:
    """The estimate of Jaccard similarity from the number of ones in the XOR of two sketches."""
    return 1 - np.log(np.maximum(1 - 2 * flips / BITS, 1e-9)) / np.log(1 - 2 / BITS) / 2 / SAMPLES


def sketch(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Odd sketches, one row of bytes per set; ``hashes`` holds the sets one after another from ``starts`` on."""
    rng = np.random.default_rng(7)
    low = _mix(hashes).astype(np.uint32)
    multiply, add = rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
    out = np.empty((len(starts), BITS // 8), np.uint8)
    ends = np.append(starts[1:], len(hashes))
    # blocks of sets whose words stay in the processor's cache over all samples
    for k in range(0, len(starts), BLOCK):
        first, last = starts[k], ends[min(k + BLOCK, len(starts)) - 1]
        x, begin = low[first:last], starts[k : k + BLOCK] - first
        least = np.empty((len(begin), SAMPLES), np.uint64)
        for j in range(SAMPLES):
            least[:, j] = np.minimum.reduceat(x * multiply[j] + add[j], begin)
        bit = _mix(least * _U(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64)) % _U(BITS)
        cells = bit.astype(np.int64) + np.arange(len(begin))[:, None] * BITS
        ones = np.bincount(cells.ravel(), minlength=len(begin) * BITS).astype(np.uint8) & 1
        out[k : k + BLOCK] = np.packbits(ones.reshape(-1, BITS), axis=1)
    return out


def most_differing(total: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """In how many words two sets of ``total`` words together can differ if they share ``threshold`` of their union."""
    return np.floor(total * (1 - threshold) / (1 + threshold) + 1e-6).astype(np.int64)


def _part_numbers(most: int) -> np.ndarray:
    """The numbers of parts in use, up to the first that is ``most`` or more: they grow by a fifth, so that a set of any
    size is dealt a few times."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 6 // 5))
    return np.array(out)


def bands(hashes: np.ndarray, rarity: np.ndarray, sets: float, starts: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(set number, band value) of every set; sets that share ``threshold`` of their union have a value in common.

    Two sets that differ in d words are dealt to the same m parts, with m * (SPREAD + 1) > d, so that some part holds
    SPREAD of these words or fewer. Each word of a part has a vector of SPREAD + 1 bits; a code takes the words whose
    vector has an odd product with it, and as any SPREAD vectors have a code that is orthogonal to all, its words are
    the same in both sets. A code with a word that ``sets`` sets hold but once is left out, as no other set has it.
    """
    n = np.diff(np.append(starts, len(hashes)))
    owner = np.repeat(np.arange(len(n)), n)
    width, light, alone = len(CODES) + 1, math.log2(sets) - SLACK, round(math.log2(sets) * 4) / 4
    # equal sums of quarters are equal whatever their order, so that both sets of a pair find the same codes light
    weight = np.where(rarity >= alone, 1e6, rarity)
    least, most = (most_differing(n + other, threshold) // (SPREAD + 1) + 1 for other in (np.ceil(n * threshold - 1e-6), np.floor(n / threshold + 1e-6)))
    numbers = _part_numbers(int(most.max(initial=1)))
    low, high = np.searchsorted(numbers, least), np.searchsorted(numbers, most)
    held, values = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for at in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        on = np.flatnonzero((low <= at) & (at <= high))
        if not len(on):
            continue
        place = np.full(len(n), -1)
        place[on] = np.arange(len(on))
        o = place[owner]
        o, h, w = o[o >= 0], hashes[o >= 0], weight[o >= 0]
        m = int(numbers[at])
        mixed = _mix(h ^ _mix(np.array([m], np.uint64)))
        cell = (o * m + (mixed % _U(m)).astype(np.int64)) * width + 1 + ((mixed >> _U(40)) % _U(len(CODES))).astype(np.int64)
        part = o * (SPREAD + 1) * m + (_mix(mixed) % _U((SPREAD + 1) * m)).astype(np.int64)
        total, second = np.zeros(len(on) * m * width, np.uint64), np.zeros(len(on) * (SPREAD + 1) * m, np.uint64)
        np.add.at(total, cell, _mix(mixed + _U(1)))
        np.add.at(second, part, _mix(mixed + _U(2)))
        total, second = total.reshape(-1, m, width), second.reshape(len(on), -1)
        bits = np.bincount(cell, weights=w, minlength=total.size).reshape(total.shape)
        for code in CODES:
            odd = [k for k in CODES if (k & code).bit_count() % 2]
            rare = bits[:, :, odd].sum(2)
            name = (np.arange(m, dtype=np.uint64) * _U(width) + _U(code) + _U(m << 32)) * _U(0xD6E8FEB86659FD93)
            value = _mix(total[:, :, odd].sum(2) + name)
            x, y = np.nonzero((rare >= light) & (rare < 1e6))
            held.append(on[x])
            values.append(value[x, y])
            x, y = np.nonzero(rare < light)
            held.append(np.repeat(on[x], second.shape[1]))
            values.append(_mix(_mix(second[x] + np.arange(second.shape[1], dtype=np.uint64)) ^ value[x, y][:, None]).ravel())
    return np.concatenate(held), np.concatenate(values)


def parity(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits for each set, one for each counter of words by hash: whether the number is odd. The XOR of two has at
    most as many ones as there are words in which the sets differ."""
    return np.bitwise_xor.reduceat(_U(1) << (_mix(hashes ^ _U(0x5DEECE66D)) & _U(63)), starts)


class _Hashes(dict):
    """64-bit hashes of words, kept as long as they are few."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


_hashes = _Hashes()


def _hash_words(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))


def _widened(short: np.ndarray) -> np.ndarray:
    """64-bit values of stored 32-bit hashes, for bands, sketches and counters."""
    return _mix(short.view(np.uint32).astype(np.uint64) + _U(0x9E3779B97F4A7C15))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(44)).astype(np.int64)


_SCAN = "id long, key binary, words_id long, n int, hashes array<int>, chunk int, counts binary"


def _scanned(paragraphs: DataFrame, form: Form) -> DataFrame:
    """Of one pass over the contents: a row per eligible paragraph, rows with the frequency of words (chunk from 0 on),
    the number of sets they were counted in (chunk -1) and the frequency of look-alike strings (chunk -2)."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, members, counted_sets = np.zeros(SLOTS, np.int64), MemberCounter(), 0
        for batch in batches:
            ids, content, is_table = (batch.column(k).to_pylist() for k in range(3))
            members.add(content)
            seen: dict = {}
            sets: dict = {}
            rows, tokens, starts = [], [], []
            for i, c, t in zip(ids, content, is_table):
                if c is None:
                    continue
                got = seen.get((c, t))
                if got is None:
                    text = form(c)
                    run = words(text)
                    distinct = frozenset(run)
                    got = ()
                    whole = "".join(run)
                    if len(distinct) >= MIN_WORDS and len(whole) >= MIN_LETTERS_DIGITS:
                        fields = record(c, t, form)[1] if t else [whole]
                        codes = sorted(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in fields)
                        got = xxhash.xxh3_128_digest(b"".join(codes), seed=int(t)), distinct
                    seen[c, t] = got
                if not got:
                    continue
                key, distinct = got
                number = sets.get(distinct)
                fresh = number is None
                if fresh:
                    number = sets[distinct] = len(starts)
                    starts.append(len(tokens))
                    tokens.extend(distinct)
                rows.append((i, key, number, len(distinct) if fresh else 0, len(distinct)))
            if not rows:
                continue
            hashes = _hash_words(tokens)
            words_id = _mix(np.add.reduceat(_mix(hashes), np.array(starts))).view(np.int64)
            short = hashes.astype(np.uint32).view(np.int32)
            total += np.bincount(_slots(_widened(short)), minlength=SLOTS)
            counted_sets += len(starts)
            # sets are numbered in the order of their first rows, so the lists of these follow one another
            at = np.concatenate([[0], np.cumsum([r[3] for r in rows])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array(words_id[[r[2] for r in rows]]),
                pa.array([r[4] for r in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(short)),
                pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], _NAMES)
        tables = [members.packed(), np.array([counted_sets], np.int64).tobytes(), *(total[k : k + CHUNK].tobytes() for k in range(0, SLOTS, CHUNK))]
        n = len(tables)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32())),
            pa.array(range(-2, n - 2), pa.int32()), pa.array(tables, pa.binary())], _NAMES)

    kind = F.coalesce(F.lower("paragraph_type") == "table", F.lit(False))
    return mapped(spread(paragraphs.select(F.col("id").cast("long"), "content", kind.alias("t"))), scan, _SCAN)


_NAMES = [x.split()[0] for x in _SCAN.split(", ")]


class Scan:
    """The scanned paragraphs of a table: ``rows`` (id, key among copies as in problem 5, words_id of its set of words,
    that set's size n, and the hashes of its words once per batch, else none), the ``form`` of the text, the number of
    ``sets`` counted, and how rare words are: ``rarity`` in quarter bits by counter.

    Frequencies cover all rows; equal contents count once per batch, so that a text copied all over the corpus doesn't
    make its words common. What comes to the driver is one table of SLOTS counters, whatever the corpus; words that
    share a counter seem less rare. The form is assumed to be the one that Unicode alone suggests; should the corpus
    be written otherwise, the pass is repeated with the form that it shows.
    """

    def __init__(self, paragraphs: DataFrame) -> None:
        self.form = Form(representatives({}))
        while True:
            scan = cut(_scanned(paragraphs, self.form), "near-rows")
            counts = {r.chunk: r.counts for r in scan.filter("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(_added, "chunk int, counts binary").collect()}
            seen = Form(representatives(MemberCounter.unpacked(counts.get(-2))))
            if seen.to == self.form.to:
                break
            drop_cut(scan)
            self.form = seen
        n = max(2, int(np.frombuffer(counts[-1], np.int64)[0]) if counts else 0)
        frequency = np.concatenate([np.frombuffer(counts[k], np.int64) for k in range(SLOTS // CHUNK)]) if counts else np.zeros(SLOTS, np.int64)
        bits = np.maximum(0.25, np.log2(n / np.maximum(frequency, 1)))
        self.rarity, self.sets = np.clip(np.round(bits * 4), 0, 255).astype(np.uint8), n
        self.rows = scan.filter("chunk is null").select("id", "key", "words_id", "n", "hashes")


def _added(group: pa.Table) -> pa.Table:
    """The sum of the tables of one chunk."""
    parts = group.column("counts").to_pylist()
    if group.column("chunk")[0].as_py() == -2:
        total = MemberCounter()
        for x in parts:
            total.merge(x)
        whole = total.packed()
    else:
        whole = sum(np.frombuffer(x, np.int64) for x in parts).tobytes()
    return pa.table({"chunk": group.column("chunk")[:1], "counts": pa.array([whole], pa.binary())})


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a column of lists one after another, and where each list starts."""
    offsets = column.offsets.to_numpy()
    return _widened(column.flatten().to_numpy(zero_copy_only=False)), (offsets[:-1] - offsets[0]).astype(np.int64)


def sketches(fresh: DataFrame) -> DataFrame:
    """(words_id, n, s0, s1, ...): the odd sketch of each set, in 64-bit words."""
    names = ["words_id", "n", *(f"s{k}" for k in range(BITS // 64))]

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                odd = sketch(*_lists(batch.column(2))).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(odd[:, k])) for k in range(BITS // 64))], names)

    held = mapped(fresh.select("words_id", "n", "hashes"), fold, "words_id long, n int, " + ", ".join(f"{x} long" for x in names[2:]))
    return held.groupBy("words_id").agg(*[F.first(x).alias(x) for x in names[1:]])


def candidates(fresh: DataFrame, rarity: np.ndarray, sets: float, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(words_a, words_b), a < b: pairs of sets that share a band value, but for those whose sizes or parities show that
    they are less similar than the threshold. Values are shuffled in packs, one for each batch and bucket of values; a
    task holds the values of one bucket at a time, and pairs are made in slices. The sets of a value held by more than
    ``hot`` are cut into blocks, whose pairs are spread over all tasks. No bucket is capped."""
    buckets = int(fresh.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["bucket", "ids", "odd", "sizes", "counts", "packed"]

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, starts = _lists(batch.column(1))
            ids, odd, sizes = batch.column(0).to_numpy(), parity(hashes, starts), np.diff(np.append(starts, len(hashes))).astype(np.int32)
            owner, values = bands(hashes, rarity[_slots(hashes)] / 4, sets, starts, threshold)
            bucket = ((values >> _U(8 * VALUE_BYTES)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket * len(ids) + owner, kind="stable")
            owner, values = owner[order], values[order]
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                if ends[k] == ends[k + 1]:
                    continue
                held, counts = np.unique(owner[ends[k] : ends[k + 1]], return_counts=True)
                short = values[ends[k] : ends[k + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :VALUE_BYTES]
                rows.append((k, *(x.tobytes() for x in (ids[held], odd[held], sizes[held], counts.astype(np.int32), short))))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names)

    def near(odd_a, odd_b, size_a, size_b) -> np.ndarray:
        """As many ones as words may differ, no more, and sizes as far apart as may be."""
        total = size_a + size_b
        out = np.bitwise_count(odd_a ^ odd_b) <= total * ((1 - threshold) / (1 + threshold)) + 1e-6
        return out & (np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b) - 1e-6)

    def unpacked(packs: list[tuple]) -> tuple[np.ndarray, ...]:
        ids, odd, sizes, counts, packed = (np.frombuffer(b"".join(c), t) for c, t in zip(zip(*packs), (np.int64, np.uint64, np.int32, np.int32, np.uint8)))
        v = np.zeros((len(packed) // VALUE_BYTES, 8), np.uint8)
        v[:, :VALUE_BYTES] = packed.reshape(-1, VALUE_BYTES)
        return ids, odd, sizes, counts, v.view("<u8").ravel()

    def too_long(v: np.ndarray) -> np.ndarray:
        """Which of sorted values stand in runs of more than ``hot``."""
        far = np.flatnonzero(v[hot:] == v[:-hot]) if len(v) > hot else np.empty(0, np.int64)
        out = np.zeros(len(v) + 1, np.int64)
        np.add.at(out, far, 1)
        np.add.at(out, far + hot + 1, -1)
        return np.cumsum(out[:-1]) > 0

    def pairs(packs: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The pairs of one bucket but for those of hot values."""
        ids, odd, sizes, counts, v = unpacked(packs)
        order = np.argsort(v)
        v, w = v[order], np.repeat(np.arange(len(ids), dtype=np.int32), counts)[order]
        # only runs of equal values matter
        run = np.append(v[1:] == v[:-1], False)
        run[1:] |= run[:-1]
        run &= ~too_long(v)
        v, w = v[run], w[run]
        at, step = np.arange(len(v)), 1
        while len(at := at[at + step < len(v)]) and len(at := at[v[at + step] == v[at]]):
            a, b = w[at], w[at + step]
            some = near(odd[a], odd[b], sizes[a], sizes[b]) & (ids[a] != ids[b])
            a, b = ids[a[some]], ids[b[some]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["words_a", "words_b"])
            step += 1

    def blocks(packs: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The sets of the hot values of one bucket, as pairs of blocks."""
        ids, odd, sizes, counts, v = unpacked(packs)
        if len(v) <= hot or not too_long(np.sort(v)).any():
            return
        order = np.argsort(v)
        long = too_long(v[order])
        v, w = v[order][long], np.repeat(np.arange(len(ids), dtype=np.int32), counts)[order][long]
        edges = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for begin, end in zip(edges, edges[1:]):
            cuts = [b"".join(x[w[k : min(k + hot, end)]].tobytes() for x in (ids, odd, sizes)) for k in range(begin, end, hot)]
            for k, left in enumerate(cuts):
                yield pa.RecordBatch.from_arrays([pa.array([left] * (len(cuts) - k), pa.binary()), pa.array(cuts[k:], pa.binary())], ["left", "right"])

    def crossed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of two blocks, or of one with itself."""
        def parts(x: bytes):
            n = len(x) // 20
            return np.frombuffer(x, np.int64, n), np.frombuffer(x, np.uint64, n, 8 * n), np.frombuffer(x, np.int32, n, 16 * n)
        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (i, p, m), (j, q, n) = parts(left), parts(right)
                for k in range(len(i)):
                    some = near(p[k], q, m[k], n) & ((j > i[k]) if left == right else (j != i[k]))
                    if some.any():
                        b = j[some]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i[k], b)), pa.array(np.maximum(i[k], b))], ["words_a", "words_b"])

    def each_bucket(judge):
        def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, packs = None, []
            for batch in batches:
                for k, *pack in zip(*(c.to_pylist() for c in batch.columns)):
                    if k != bucket:
                        yield from judge(packs) if packs else ()
                        bucket, packs = k, []
                    packs.append(pack)
            yield from judge(packs) if packs else ()
        return stream

    packed = mapped(fresh.select("words_id", "hashes"), deal, "bucket int, ids binary, odd binary, sizes binary, counts binary, packed binary")
    met = packed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    found = "words_a long, words_b long"
    # both read the same exchange; pairs of blocks are none unless a value is hot
    spread = mapped(met, each_bucket(blocks), "left binary, right binary").repartition(buckets)
    return mapped(met, each_bucket(pairs), found).unionByName(mapped(spread, crossed, found))


def similar_sets(scan: Scan, evidence: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(words_a, words_b, flips, share): pairs of different sets of words that share ``threshold`` of their union, with
    the ones in the XOR of their odd sketches and the share itself.

    ``evidence`` may hold further candidates (words_a, words_b). Copies take part once, as the sets are compared and
    not the rows. Sketches drop what is clearly less similar; the words decide, compared by 32-bit hashes, of which two
    in a pair of sets are equal by chance once in some million pairs. Two sets similar to a third are candidates too.
    """
    fresh = scan.rows.filter("size(hashes) > 0")
    pairs = candidates(fresh, scan.rarity, scan.sets, threshold)
    if evidence is not None:
        pairs = pairs.unionByName(evidence)
    held = sketches(fresh)
    side = lambda x: held.select(F.col("words_id").alias(f"words_{x}"), *[F.col(f"s{k}").alias(f"s{x}{k}") for k in range(BITS // 64)], F.col("n").alias(f"n_{x}"))
    pairs = cut(pairs.distinct(), "near-candidates")
    judged = pairs.join(side("a"), "words_a").join(side("b"), "words_b")
    flips = sum((F.bit_count(F.col(f"sa{k}").bitwiseXOR(F.col(f"sb{k}"))) for k in range(BITS // 64)), F.lit(0))
    close = cut(judged.filter((flips <= most_flips(threshold)) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)).select("words_a", "words_b", flips.alias("flips")), "near-pairs")
    drop_cut(pairs)

    ends = close.select(F.explode(F.array("words_a", "words_b")).alias("words_id")).distinct()
    sets = cut(fresh.select("words_id", "hashes").join(ends, "words_id").groupBy("words_id").agg(F.first("hashes").alias("hashes")), "near-words")
    a, b = (sets.select(F.col("words_id").alias(f"words_{x}"), F.col("hashes").alias(f"h_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("h_a", "h_b"))
    # whole numbers decide, so that a share of exactly the threshold counts
    enough = shared * 1000 >= (F.size("h_a") + F.size("h_b") - shared) * round(threshold * 1000)
    share = shared / (F.size("h_a") + F.size("h_b") - shared)
    sure = cut(close.join(a, "words_a").join(b, "words_b").filter(enough).select("words_a", "words_b", "flips", share.alias("share")), "similar-sets")
    for done in (close, sets):
        drop_cut(done)
    return sure


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The scanned rows, and the similar pairs of sets of words. Pairs of earlier results are candidates as well."""
    paragraphs = table(spark, sf_dir, "paragraphs")
    scan = Scan(paragraphs)
    ids = scan.rows.select("id", "words_id")
    earlier = table(spark, sf_dir, "similarity_results").select("paragraph1_id", "paragraph2_id").distinct()
    earlier = earlier.join(ids.select(F.col("id").alias("paragraph1_id"), F.col("words_id").alias("x")), "paragraph1_id").join(
        ids.select(F.col("id").alias("paragraph2_id"), F.col("words_id").alias("y")), "paragraph2_id").filter("x <> y")
    return scan.rows, similar_sets(scan, earlier.select(F.least("x", "y").alias("words_a"), F.greatest("x", "y").alias("words_b")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of paragraphs, by the similar pairs of their sets of words; equal sets in different groups count too."""
    rows, pairs = _edited(spark, sf_dir)
    held = rows.select("words_id", "id", "key")
    a, b = (held.select(F.col("words_id").alias(f"words_{x}"), F.col("id").alias(f"id_{x}"), F.col("key").alias(f"key_{x}")) for x in "ab")
    mixed = held.groupBy("words_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x <> y").select(F.col("words_id").alias("words_a"), F.col("words_id").alias("words_b"))
    linked = pairs.select("words_a", "words_b").unionByName(mixed).join(a, "words_a").join(b, "words_b").filter("key_a <> key_b and (words_a <> words_b or id_a < id_b)")
    return linked.select(F.least("id_a", "id_b").alias("paragraph_a"), F.greatest("id_a", "id_b").alias("paragraph_b"))


def _classes(rows: DataFrame) -> DataFrame:
    """(id, words_id, class_id): paragraphs of equal sets of words are one class, named by its smallest id."""
    return rows.select("id", "words_id").join(rows.groupBy("words_id").agg(F.min("id").alias("class_id")), "words_id")


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paragraph_id, class_id, group_id, links): every paragraph of 60 letters and digits and 15 different words, with
    its class, the group that similar pairs link its class to directly or indirectly (by the smallest id), and the
    number of other classes similar to its own. Copies are not expanded into pairs."""
    rows, pairs = _edited(spark, sf_dir)
    classes = cut(_classes(rows), "near-classes")
    linked = cut(_class_pairs(classes, pairs), "near-class-pairs")
    groups = components(linked.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))).select(F.col("v").alias("class_id"), "group_id")
    ends = linked.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    told = classes.join(groups, "class_id", "left").join(ends, "class_id", "left")
    return told.select(F.col("id").alias("paragraph_id"), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _class_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    names = classes.select("words_id", "class_id").distinct()
    a, b = (names.select(F.col("words_id").alias(f"words_{x}"), F.col("class_id").alias(x)) for x in "ab")
    return pairs.join(a, "words_a").join(b, "words_b").select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "flips", "share")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class_a, class_b, share, estimate): similar pairs of class representatives, with the share of their words and
    what their odd sketches estimate of it."""
    rows, pairs = _edited(spark, sf_dir)
    estimate = 1 - F.log(F.greatest(1 - 2 * F.col("flips") / BITS, F.lit(1e-9))) / math.log(1 - 2 / BITS) / 2 / SAMPLES
    return _class_pairs(_classes(rows), pairs).select("class_a", "class_b", F.round("share", 6).alias("share"), F.round(estimate, 6).alias("estimate"))


QUERIES = {"p4_found": p4_found, "p4_members": p4_members, "p4_pairs": p4_pairs}
