"""Noise in text from scanned pages (problem 7): lines labelled header, body or break by a hidden Markov model over
layout features; words split over line ends; misrecognised words; and the paragraphs put together again."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, mapped, spread, table
from .form import MEMBERS, Form, MemberCounter, PerToken, formed
from .quality import COMMON_WORDS

HEADER, BODY, BREAK = 0, 1, 2
#: Lines to fit the model on, about so many by a seeded order and never more than twice as many.
MOST_LINES = 20_000

_MARK = "[-‐‑­¬]"
# How page numbers are written.
_PAGE = r"(?:(?:page|seite|p\.|s\.)\s*\d+(?:\s*(?:of|von|sur|/)\s*\d+)?|\d+\s*\|\s*(?:page|seite)|\[\s*\d+\s*\]|[-–—]\s*\d+\s*[-–—]|\d{1,4}(?:\s*/\s*\d{1,4})?)"
_IS_PAGE = re.compile(rf"\s*{_PAGE}\s*$", re.I)
_PAGE_END = re.compile(rf"(?:\s*·\s*|\s*\|\s*|\s{{2,}}|\t){_PAGE}\s*$", re.I)
# the same without bare numbers, which also end lines of text
_NUMBERED_END = re.compile(rf"(?:\s*·\s*|\s{{2,}}|\t)(?!\d+\s*$){_PAGE}\s*$", re.I)
_PAGE_START = re.compile(rf"\s*{_PAGE}(?:\s*·\s*|\s*\|\s*|\s{{2,}}|\t)", re.I)


def _may_end_in_page(line: str) -> bool:
    """Whether the last character allows one of the notations of page numbers, all of which end in these."""
    last = line[-1:]
    return last.isdigit() or last in "]-–—" or last in "eE" and line[-5:].lower().endswith(("page", "seite"))


def line_key(line: str) -> str:
    """A line without its page number, in lower case and single blanks: what recurs of a running title."""
    line = line.strip()
    if _may_end_in_page(line):
        line = _PAGE_END.sub("", line)
    start = _PAGE_START.match(line)
    return " ".join((line[start.end():] if start else line).lower().split())


def _ending(line: str) -> int:
    """2 after a hyphen mark, 1 after punctuation that ends a sentence or a part of one, else 0."""
    last = line[-1:]
    return 2 if last in "-‐‑­¬" and last else 1 if line.rstrip("'\"”’»")[-1:] in tuple(".!?:;,") else 0


def _bare(line: str) -> str:
    return _NUMBERED_END.sub("", line) if _may_end_in_page(line) else line


def _features(line: str, alone: bool) -> int:
    """The layout of a line as one of 72 symbols; recurrence in the document makes it one of 144."""
    ends = _ending(_bare(line))
    length = 0 if len(line) < 12 else 1 if len(line) < 80 else 2
    page = bool(_IS_PAGE.match(line))
    return (((page * 3 + ends) * 3 + length) * 2 + line[:1].islower()) * 2 + alone


def _letter(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] == "M"


def _tail(line: str) -> str | None:
    """The part of a word, in lower case, before the hyphen mark that a line ends with."""
    line = _bare(line)
    if _ending(line) != 2:
        return None
    end = len(line) - 1
    while end and line[end - 1].isspace():
        end -= 1
    i = end
    while i and _letter(line[i - 1]):
        i -= 1
    return line[i:end].lower() if i < end == len(line) - 1 and any(map(str.isalpha, line[i:end])) else None


def _head(line: str) -> str | None:
    """The letters, in lower case, that a line begins with."""
    j = 0
    while j < len(line) and _letter(line[j]):
        j += 1
    return line[:j].lower() if any(map(str.isalpha, line[:j])) else None


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lines_of(text: str) -> list[tuple]:
    """(line number, symbol, key, context, tail, head) of the lines of a text. ``key`` is a hash of what may recur, none
    for page numbers, table rows and lines without letters; ``context`` one of the lines around it, none if it stands
    alone. Heads are given where a line ends with a hyphen mark."""
    held = [(k, x.strip()) for k, x in enumerate(text.split("\n"))]
    held = [(k, x) for k, x in held if x]
    keys = [line_key(x) for _, x in held]
    tails = [_tail(x) for _, x in held]
    split = any(tails)
    out = []
    for n, (k, x) in enumerate(held):
        may_recur = any(map(str.isalpha, keys[n])) and "|" not in keys[n] and "\t" not in x and not _IS_PAGE.match(x)
        context = _hash("\n".join((keys[n - 1] if n else "", *keys[n + 1 : n + 2]))) if len(held) > 1 else None
        out.append((k, _features(x, len(held) == 1), _hash(keys[n]) if may_recur else None, context, tails[n], _head(x) if split else None))
    return out


SYMBOLS = 144


def with_recurrence(held: DataFrame) -> DataFrame:
    """``lines`` with ``seen``: the symbol, moved up by 72 if the same key stands elsewhere in the document. Lines of one
    context count once, as copies of a paragraph repeat theirs; so does a repeated row. Equal keys are counted before
    the shuffle, so a document with a third of all rows is no hot group."""
    places = held.filter("key is not null").select("document_id", "key", F.coalesce("context", "id").alias("place")).distinct()
    often = places.groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("document_id", "key", F.lit(72).alias("up"))
    return held.join(often, ["document_id", "key"], "left").select("id", "line_no", (F.col("symbol") + F.coalesce("up", F.lit(0))).alias("seen"), "tail", "head")


class Model:
    """A hidden Markov model of the lines of a paragraph, in log probabilities."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.step, self.emit = start, step, emit

    def decode(self, symbols: list[int]) -> list[int]:
        """The most likely states (Viterbi)."""
        if not symbols:
            return []
        score = self.start + self.emit[:, symbols[0]]
        back = []
        for s in symbols[1:]:
            reach = score[:, None] + self.step
            back.append(reach.argmax(0))
            score = reach.max(0) + self.emit[:, s]
        out = [int(score.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def _cue(symbol: int, last: bool) -> int | None:
    """The state that a line's layout shows beyond doubt, else None; these cues label the lines to learn from."""
    recurs, rest = divmod(symbol, 72)
    page, ends, length = rest // 36, rest // 12 % 3, rest // 4 % 3
    if page or recurs and ends == 0:
        return HEADER
    if ends == 2 or length == 2 and not last:
        return BODY
    if ends == 0 and not recurs:
        # a heading, or a text without an end, stands alone; within a paragraph this is a line of text
        return BREAK if rest % 2 else BODY
    if ends == 1 and last:
        return BREAK
    return None


def fit(sequences: list[list[int]], rounds: int = 5) -> Model:
    """A model fitted by expectation maximisation, begun from and bound to the lines whose cues leave no doubt."""
    prior = np.array([[4.0, 4.0, 2.0], [2.0, 20.0, 6.0], [2.0, 12.0, 2.0]])
    start, step, emit = np.array([1.0, 4.0, 2.0]), prior.copy(), np.full((3, SYMBOLS), 0.1)
    cues = [[_cue(s, k == len(q) - 1) for k, s in enumerate(q)] for q in sequences]
    for q, c in zip(sequences, cues):
        for s, state in zip(q, c):
            if state is not None:
                emit[state, s] += 1
    model = None
    for _ in range(rounds):
        a, t, e = start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)
        model = Model(np.log(a), np.log(t), np.log(e))
        start, step, emit = np.ones(3), prior.copy(), np.full((3, SYMBOLS), 0.1)
        whole = Counter(zip(map(tuple, sequences), map(tuple, cues)))
        for (q, c), n in whole.items():
            out = np.array([e[:, s] * ([1, 1, 1] if x is None else np.eye(3)[x]) for s, x in zip(q, c)]) + 1e-12
            f, b = np.empty_like(out), np.ones_like(out)
            f[0] = a * out[0]
            f[0] /= f[0].sum()
            for k in range(1, len(q)):
                f[k] = f[k - 1] @ t * out[k]
                f[k] /= f[k].sum()
            for k in range(len(q) - 2, -1, -1):
                b[k] = t @ (out[k + 1] * b[k + 1])
                b[k] /= b[k].sum()
            g = f * b
            g /= g.sum(1, keepdims=True)
            start += n * g[0]
            for k, s in enumerate(q):
                emit[:, s] += n * g[k]
            for k in range(len(q) - 1):
                x = f[k][:, None] * t * (out[k + 1] * b[k + 1])
                step += n * x / x.sum()
    return model


def _sequences(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(id, line numbers, symbols, tails, heads) of rows (id, line_no, seen, tail, head) that come in order."""
    for i, held in groupby(rows, key=lambda r: r[0]):
        yield i, *zip(*(r[1:] for r in held))


def labelled(seen: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """(id, headers, breaks, splits): of every paragraph in ``seen`` the numbers of its lines labelled header and break,
    and the words that a hyphen mark splits between lines that follow one another once headers are left out, as their
    two parts with a hyphen. The model is fitted on the lines of a seeded sample of paragraphs with about ``most``
    lines, at most twice as many, and decodes all."""
    parts = 1_000_000
    share = max(1, min(parts, parts * most // max(1, seen.count())))
    order = F.xxhash64(F.lit(5), "id")
    sample = seen.filter(F.pmod(order, F.lit(parts)) < share).orderBy(order, "id", "line_no").limit(2 * most).select("id", "line_no", "seen", "tail", "head").toPandas()
    model = fit([list(q[2]) for q in _sequences(sample.sort_values(["id", "line_no"]).itertuples(index=False, name=None))])

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(5)))
        done: dict = {}
        out = []

        def packed(out):
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "headers", "breaks", "splits"])

        for i, numbers, symbols, tails, heads in _sequences(rows()):
            states = done.get(symbols)
            if states is None:
                states = model.decode(symbols)
                if len(symbols) < 8 and len(done) < 100_000:
                    done[symbols] = states
            splits = []
            if any(tails):
                kept = [k for k, s in enumerate(states) if s != HEADER]
                splits = [f"{tails[k]}-{heads[n]}" for k, n in zip(kept, kept[1:]) if tails[k] and heads[n]]
            out.append((i, [k for k, s in zip(numbers, states) if s == HEADER], [k for k, s in zip(numbers, states) if s == BREAK], splits))
            if len(out) == 10_000:
                yield packed(out)
                out = []
        yield packed(out)

    ordered = seen.select("id", "line_no", "seen", "tail", "head").repartition("id").sortWithinPartitions("id", "line_no")
    return mapped(ordered, decode, "id long, headers array<int>, breaks array<int>, splits array<string>")


# How recognition confuses characters, as read and as printed.
IN_WORDS = {"0": "o", "1": "li", "5": "s", "9": "g", "8": "b", "@": "a", "$": "s"}
LETTERS = [("c", "e"), ("l", "i"), ("f", "t"), ("b", "h"), ("ii", "u"), ("cl", "d"), ("rn", "m"), ("vv", "w")]
_FUNCTION = frozenset(COMMON_WORDS.split())
_TOKEN = re.compile(r"[@$]?[^\W_]+(?:[@$]+[^\W_]+)*[@$]?")
_STRANGE = re.compile(r"[01598@$]")
_read, _compounds = PerToken(_TOKEN.findall), PerToken(re.compile(r"[^\W\d_]+[-‐][^\W\d_]+").findall)
#: A word of letters is misread if the word it confuses is so many times as frequent, and occurs so often.
TIMES, LEAST = 8, 8
#: Words in at most so many contents of a batch are kept with the rows that hold them.
POSTED = 8
#: Readings of words with up to so many '1', each an 'l' or 'i', are listed; those of others are matched by folded form.
MOST_ONES = 4
#: Text of so many different words and more, none of them a function word, is made up unless the corpus knows this share
#: of them, as words in LEAST contents or more; what looks misread there is not.
MADE_UP_WORDS, MADE_UP = 12, 0.5


_SCAN = "id long, document_id long, line_no int, symbol int, key long, context long, tail string, head string, word string, n long, ids array<long>, tokens array<string>, " + MEMBERS


def scanned(paragraphs: DataFrame, form: Form) -> DataFrame:
    """Of one pass over the contents, in their consistent form:

    * (id, document_id, line_no, symbol, key, context, tail, head): the lines of every paragraph, see :func:`_lines_of`;
    * (word, n, ids): words of a batch with the number of different contents that hold them, and for words that may be
      misread the ids of the rows: words in few contents, and words that stand for one more frequent in the same batch.
      Words and compounds split by a hyphen inside a line are in lower case;
    * (ids, tokens): the rows and words of a content that may be made up;
    * the rows that :func:`~.form.formed` counts.
    """
    names = [x.split()[0] for x in _SCAN.split(", ")]
    kinds = dict(zip(names, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string(), pa.int64()]))

    def packed(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[x], t) if x in columns else pa.nulls(rows, t) for x, t in kinds.items()], names)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = MemberCounter()
        for batch in batches:
            rows: dict[str, list[tuple]] = {}
            contents = batch.column(2).to_pylist()
            members.add(contents)
            for i, d, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), contents):
                if c:
                    rows.setdefault(c, []).append((i, d))
            counted: Counter = Counter()
            sets, doubtful, layout = [], [], []
            for c, held in rows.items():
                text = form(c)
                found = _lines_of(text)
                layout += [(i, d, *x) for i, d in held for x in found]
                tokens = set(text.lower().split())
                found = set(chain.from_iterable(map(_read.__getitem__, tokens)))
                sets.append(found)
                if len(found) >= MADE_UP_WORDS and _FUNCTION.isdisjoint(found):
                    doubtful.append(([i for i, _ in held], [w for w in found if len(w) > 2 and not w.isdigit()]))
                counted.update(found)
                if "-" in text:
                    counted.update(set(chain.from_iterable(map(_compounds.__getitem__, tokens))))
            if layout:
                yield packed(len(layout), **dict(zip(names, zip(*layout))))
            for w in [w for w in counted if len(w) < 3 or w.isdigit()]:
                del counted[w]

            def posted(w: str, n: int) -> bool:
                return "-" not in w and (n <= POSTED or any(counted[r] >= (n if strange else TIMES // 2 * n) for r, strange in readings(w).items() if r in counted))

            ids: dict[str, list[int]] = {w: [] for w, n in counted.items() if posted(w, n)}
            some = ids.keys()
            for found, held in zip(sets, rows.values()):
                for w in found & some:
                    ids[w].extend(i for i, _ in held)
            none = [None] * len(doubtful)
            yield packed(len(counted) + len(none), word=[*counted, *none], n=[*counted.values(), *none], ids=[*(ids.get(w) for w in counted), *(x for x, _ in doubtful)],
                         tokens=[*[None] * len(counted), *(x for _, x in doubtful)])
        counts = members.counts()
        yield packed(len(counts), member=list(counts), member_n=list(counts.values()))

    return mapped(spread(paragraphs.select(F.col("id").cast("long"), F.col("document_id").cast("long"), "content")), scan, _SCAN)


def lines(rows: DataFrame) -> DataFrame:
    """The lines among the rows of :func:`scanned`."""
    return rows.filter("line_no is not null").select("id", "document_id", "line_no", "symbol", "key", "context", "tail", "head")


def word_counts(rows: DataFrame) -> DataFrame:
    """The words, and the contents that may be made up, among the rows of :func:`scanned`."""
    return rows.filter("word is not null or tokens is not null").select("word", "n", "ids", "tokens")


def readings(word: str) -> dict[str, bool]:
    """What a word in lower case may have been before recognition, with whether it holds characters that words don't."""
    out: dict[str, bool] = {}
    letters = sum(c.isalpha() for c in word)
    if _STRANGE.search(word):
        if letters < 2 or any(c.isdigit() and c not in IN_WORDS for c in word):
            return out
        if word.count("1") > MOST_ONES:
            return out
        plain = [""]
        for c in word:
            plain = [p + x for p in plain for x in IN_WORDS.get(c, c)]
        out |= {p: True for p in plain}
        for p in plain:
            for wrong, right in LETTERS:
                out |= {p[:k] + right + p[k + len(wrong):]: True for k in range(len(p)) if p.startswith(wrong, k)}
    elif letters == len(word) > 3:
        for wrong, right in LETTERS:
            out |= {word[:k] + right + word[k + len(wrong):]: False for k in range(len(word)) if word.startswith(wrong, k)}
    return out


def open_readings(word: str) -> set[tuple[str, str]]:
    """Of a word with more than MOST_ONES '1', whose ``readings`` are too many to list: (folded, pattern) of what it may
    have been, in which each 'i' is folded to 'l' and the pattern tells the words of that form that fit."""
    if word.count("1") <= MOST_ONES or sum(c.isalpha() for c in word) < 2 or any(c.isdigit() and c not in IN_WORDS for c in word):
        return set()
    plain = [IN_WORDS.get(c, c) for c in word]
    ways = [plain]
    for wrong, right in LETTERS:
        ways += [plain[:k] + list(right) + plain[k + len(wrong):] for k in range(len(plain) - len(wrong) + 1) if all(c in plain[k + j] for j, c in enumerate(wrong))]
    return {("".join("l" if "i" in x else x for x in w), "^" + "".join(f"[{x}]" if len(x) > 1 else x for x in w) + "$") for w in ways}


def misread_words(counts: DataFrame) -> DataFrame:
    """(word, reading) of the words that stand for a more frequent word with characters confused."""
    frequency = cut(counts.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")

    def vary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, n, r, s) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r, s in readings(w).items()]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_()))], ["word", "n", "reading", "strange"])

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, n, *x) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in open_readings(w)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["word", "n", "fold", "pattern"])

    varied = mapped(frequency, vary, "word string, n long, reading string, strange boolean")
    known = frequency.select(F.col("word").alias("reading"), F.col("n").alias("known"))
    many = mapped(frequency.filter(F.length("word") - F.length(F.replace("word", F.lit("1"), F.lit(""))) > MOST_ONES), folded, "word string, n long, fold string, pattern string")
    of_fold = frequency.filter(~F.col("word").rlike("[0-9]")).select(F.translate("word", "i", "l").alias("fold"), F.col("word").alias("reading"))
    varied = varied.unionByName(many.join(of_fold, "fold").filter("reading rlike pattern").select("word", "n", "reading", F.lit(True).alias("strange")).distinct())
    fits = F.when(F.col("strange"), F.col("known") >= F.col("n")).otherwise((F.col("known") >= LEAST) & (F.col("known") >= TIMES * F.col("n")))
    return varied.join(known, "reading").filter(fits).groupBy("word").agg(F.max_by("reading", F.struct("known", "reading")).alias("reading"))


def misread(paragraphs: DataFrame, counts: DataFrame, form: Form) -> tuple[DataFrame, DataFrame]:
    """(id, word, reading) of every misread word of every paragraph, and the misread words themselves."""
    wrong = cut(misread_words(counts), "misread")
    out = counts.filter("ids is not null").join(wrong, "word").select(F.explode("ids").alias("id"), "word", "reading")
    # a misread word that is frequent in some batch has no ids there: its rows are found by a join on all words
    rest = counts.filter("ids is null").join(wrong, "word").select("word", "reading").distinct()
    if not rest.isEmpty():
        def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, w) for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if c for w in set(chain.from_iterable(map(_read.__getitem__, form(c).lower().split())))]
                columns = list(zip(*rows)) or [()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], ["id", "word"])
        out = out.unionByName(mapped(paragraphs.select(F.col("id").cast("long"), "content"), tokens, "id long, word string").join(rest, "word"))
    out = cut(out.distinct(), "misread-rows")
    held = counts.filter("word is null").select(F.explode("ids").alias("id"), "tokens").join(out.select("id").distinct(), "id", "left_semi").select("id", F.explode("tokens").alias("word"))
    known = counts.join(held.select("word").distinct(), "word", "left_semi").groupBy("word").agg((F.sum("n") >= LEAST).cast("int").alias("known"))
    made_up = held.join(known, "word").groupBy("id").agg(F.avg("known").alias("share")).filter(F.col("share") < MADE_UP)
    return out.join(made_up, "id", "left_anti"), wrong


def split_words(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(id) of paragraphs with a word split over a line end, by the lines as labelled: a word goes on in the next line
    that is no header. A compound that keeps its own hyphen there is none: it is found hyphenated inside lines, and
    never in one word."""
    parts = labels.filter("size(splits) > 0").select("id", F.explode("splits").alias("compound")).withColumn("word", F.replace("compound", F.lit("-"), F.lit("")))
    compounds = counts.filter("word like '%-%'").select(F.col("word").alias("compound")).distinct()
    doubtful = parts.join(compounds, "compound", "left_semi")
    whole = counts.filter("word not like '%-%'").select("word").distinct()
    kept = doubtful.join(whole, "word", "left_anti").select("id", "word")
    return parts.select("id", "word").distinct().join(kept, ["id", "word"], "left_anti").select("id").distinct()


def _parts(spark: SparkSession, sf_dir: str):
    paragraphs = table(spark, sf_dir, "paragraphs")
    rows, form = formed(lambda form: scanned(paragraphs, form), "scan")
    seen = cut(with_recurrence(lines(rows)), "seen")
    return paragraphs, form, word_counts(rows), cut(labelled(seen), "labels")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraphs, form, counts, labels = _parts(spark, sf_dir)
    noise = lambda ids, name: ids.select(F.col("id").alias("paragraph_id"), F.lit(name).alias("noise"))
    wrong = misread(paragraphs, counts, form)[0].select("id").distinct()
    return noise(split_words(labels, counts), "hyphen").unionByName(noise(wrong, "misread")).unionByName(noise(labels.filter(F.size("headers") > 0), "running"))


def repaired(content: str, headers: list[int], breaks: list[int], wrong: dict[str, str]) -> str:
    """A content without header lines, split words joined, misread words replaced by their readings, and lines run
    together up to each break. Case follows the word replaced, as far as it starts with a capital or has no small
    letters."""
    out = ""
    drop, stop = set(headers), set(breaks)
    for k, line in enumerate(content.split("\n")):
        if k in drop or not line.strip():
            continue
        out += line.strip() + ("\n" if k in stop else " ")
    out = re.sub(rf"([^\W\d_]){_MARK}[ \n]+(?=[^\W\d_])", r"\1", out)
    out = re.sub(rf"({_MARK})\n", r"\1 ", out).strip()
    if wrong:
        def put(m):
            new = wrong.get(m[0].lower())
            if new is None:
                return m[0]
            return new.upper() if m[0].isupper() else new.capitalize() if m[0][:1].isupper() else new
        out = _TOKEN.sub(put, out)
    return out


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content) of every paragraph, repaired; page furniture alone becomes an empty text."""
    paragraphs, form, counts, labels = _parts(spark, sf_dir)
    words = misread(paragraphs, counts, form)[0].groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "reading"))).alias("wrong"))
    rows = paragraphs.select(F.col("id").cast("long"), "content").join(labels, "id", "left").join(words, "id", "left")

    def mend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [c if c is None or h is None and w is None else repaired(form(c), h or [], b or [], dict(w or []))
                   for c, h, b, w in zip(*(batch.column(k).to_pylist() for k in range(1, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], ["id", "content"])

    return mapped(rows.select("id", "content", "headers", "breaks", "wrong"), mend, "id long, content string")


QUERIES = {"p7_found": p7_found, "p7_repaired": p7_repaired}
