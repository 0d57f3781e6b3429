"""Evaluation texts that stand in documents (problem 8)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import mapped, spread, table
from .form import Form, learned, words

#: So many consecutive words of an item make a leak.
RUN = 12
#: Windows of words in one automaton; more items than that are scanned for in several passes over the text.
WINDOWS = 200_000
_END = re.compile(r"\x1f")


def windows(text: str, form: Form, run: int = RUN) -> set[str]:
    """The runs of ``run`` consecutive words of a text; none if it has fewer words."""
    w = words(form(text))
    return {" ".join(w[k : k + run]) for k in range(len(w) - run + 1)}


class Scanner:
    """An Aho-Corasick automaton over the word windows of a block of items, and the search of a text with it."""

    def __init__(self, form: Form, by_window: dict[str, list[int]], run: int = RUN) -> None:
        self.form, self.by_window, self.run, self._automaton = form, by_window, run, None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def leaks(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, first word, words) of the longest runs of each item in ``text``, words counted from 0."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for w in self.by_window:
                # the blanks around a window keep it from starting or ending inside a word
                self._automaton.add_word(f" {w} ", w)
            self._automaton.make_automaton()
        run = words(self.form(text))
        if len(run) < self.run or not self.by_window:
            return
        normal = f" {' '.join(run)} "
        open_runs: dict[int, tuple[int, int]] = {}
        at = blanks = 0
        for end, window in self._automaton.iter(normal):
            blanks += normal.count(" ", at, end)
            at = end
            first = blanks - self.run
            for item in self.by_window[window]:
                begun, last = open_runs.get(item, (first, first - 1))
                if first > last + 1:
                    yield item, begun, last - begun + self.run
                    begun = first
                open_runs[item] = begun, first
        for item, (begun, last) in open_runs.items():
            yield item, begun, last - begun + self.run


def blocks(items: DataFrame, form: Form, run: int = RUN, most: int = WINDOWS) -> Iterator[dict[str, list[int]]]:
    """The items' windows in blocks of bounded size, with the items that hold each. Held-out items are few by nature
    (TESTDATA.md fixes 200); they stream to the driver, which keeps one block at a time."""
    by_window: dict[str, list[int]] = {}
    for row in items.filter("text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        for w in windows(row.text, form, run):
            by_window.setdefault(w, []).append(row.item_id)
        if len(by_window) >= most:
            yield by_window
            by_window = {}
    yield by_window


_SCHEMA = "doc_id long, item_id long, first_word int, n_words int, from_char int, to_char int"


def leaks(documents: DataFrame, items: DataFrame, form: Form, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, from_char, to_char): every stretch of a document's text that holds at
    least ``run`` consecutive words of an item, with its place in the original text. Null and short texts have none;
    items of fewer words than ``run`` can't leak; equal items are each reported."""

    def search(scanner: Scanner):
        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text is None:
                        continue
                    places = None
                    for item, first, n in scanner.leaks(text):
                        places = places or original_places(text, scanner.form)
                        rows.append((doc, item, first, n, places[first][0], places[first + n - 1][1]))
                columns = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _SCHEMA.split(", ")])
        return scan

    texts = spread(documents.select(F.col("doc_id").cast("long"), "text"))
    out = None
    for by_window in blocks(items, form, run):
        found = mapped(texts, search(Scanner(form, by_window, run)), _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def original_places(text: str, form: Form) -> list[tuple[int, int]]:
    """(from, to) in ``text`` of each word of its consistent form. The text is rewritten piece by piece between blanks,
    which the form keeps apart; within a piece that the form changes, all its words have the piece's place."""
    out = []
    for piece in re.finditer(r"\S+", text):
        new = form(piece[0])
        found = words(new)
        if new == piece[0] and len(new.lower()) == len(new):
            at = piece.start()
            low = new.lower()
            k = 0
            for w in found:
                k = low.index(w, k)
                out.append((at + k, at + k + len(w)))
                k += len(w)
        else:
            out.extend([(piece.start(), piece.end())] * len(found))
    return out


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return leaks(documents, table(spark, sf_dir, "eval_items"), learned(documents, "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked stretch with its place in the document."""
    return _all(spark, sf_dir)


QUERIES = {"p8_found": p8_found, "p8_places": p8_places}
