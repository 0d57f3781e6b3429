"""One consistent form for text that prints the same (problem 3), and the keys and words built on it.

Look-alike strings are joined into classes by union-find over strings and code points; each class is represented by
its member that the corpus holds most often; text is rewritten, leftmost longest match first, by one Aho-Corasick
automaton until nothing changes. Superscripts, fractions and accents stay characters of their own.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut, mapped, spread

# Letters of other scripts that print like the Latin letter after them.
LOOK_ALIKES = """
А A  В B  Е E  Ѕ S  І I  Ј J  К K  М M  Н H  О O  Р P  С C  Т T  Х X  Ү Y  Ԛ Q  Ԝ W  Ԍ G  Ӏ I
а a  е e  о o  р p  с c  у y  х x  ѕ s  і i  ј j  һ h  ԁ d  ԛ q  ԝ w  ӏ l
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X  ο o  ν v  ϳ j  ϲ c  Ϲ C
Օ O  Ս U  օ o  ս u  հ h  ո n  ց g  ɡ g  ɑ a  ı ı  µ μ
Ꭰ D  Ꭱ R  Ꭲ T  Ꭺ A  Ꭻ J  Ꭼ E  Ꮃ W  Ꮇ M  Ꮋ H  Ꮐ G  Ꮓ Z  Ꮪ S  Ꮩ V  Ꮮ L  Ꮯ C  Ꮲ P  Ꮶ K  Ᏼ B
ꓐ B  ꓑ P  ꓓ D  ꓔ T  ꓖ G  ꓗ K  ꓙ J  ꓚ C  ꓜ Z  ꓝ F  ꓟ M  ꓠ N  ꓡ L  ꓢ S  ꓣ R  ꓦ V  ꓧ H  ꓪ W  ꓫ X  ꓬ Y  ꓮ A  ꓰ E  ꓲ I  ꓳ O  ꓴ U
Ⲏ H  Ⲓ I  Ⲕ K  Ⲙ M  Ⲛ N  Ⲟ O  Ⲣ P  Ⲥ C  Ⲧ T  Ⲩ Y  Ⲭ X  ⲟ o  ⲣ p  ⲥ c
"""
# Hyphens that print like the ASCII one.
HYPHENS = "\u2010 \u2011 \ufe63 \uff0d"
SOFT_HYPHEN = "\u00ad"

class UnionFind:
    """Sets of hashable items under union; the root of a set is arbitrary."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[a] = b


def links() -> Iterator[tuple[str, str]]:
    """Pairs of strings that print the same: from the Unicode character data, and the fixed tables above."""
    alike = dict(zip(*[iter(LOOK_ALIKES.split())] * 2))
    for code in itertools.chain(range(0x80, 0x40000), range(0xE0000, 0xF0000)):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            # unassigned and private characters have no print to be alike in; the planes left out hold no others
            continue
        decomposed = unicodedata.decomposition(c)
        if kind == "Cf" and c != SOFT_HYPHEN or code == 0x34F or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            yield c, ""
        elif kind == "Zs":
            yield c, " "
        elif decomposed:
            tag, _, rest = decomposed.rpartition("> ")
            string = "".join(chr(int(x, 16)) for x in (rest or decomposed).split())
            ligature = tag == "<compat" and re.search("LIGATURE|ROMAN NUMERAL", unicodedata.name(c, ""))
            if not tag or tag in ("<wide", "<narrow", "<noBreak", "<font") or ligature:
                yield c, string
                if string[:1] in alike:
                    # an accent on a look-alike prints like the accent on the letter itself
                    yield string, alike[string[0]] + string[1:]
    yield from alike.items()
    for c in HYPHENS.split():
        yield c, "-"
    # A soft hyphen shows only at the end of a line.
    yield SOFT_HYPHEN, ""
    yield SOFT_HYPHEN + "\n", "-\n"


@functools.lru_cache(1)
def classes() -> list[tuple[str, ...]]:
    """Transitive classes of two or more strings that print the same."""
    sets = UnionFind()
    for a, b in links():
        sets.union(a, b)
    by_root: dict[str, list[str]] = {}
    for x in list(sets.parent):
        by_root.setdefault(sets.find(x), []).append(x)
    return [tuple(sorted(v)) for v in by_root.values() if len(v) > 1]


@functools.lru_cache(1)
def _counted() -> tuple[np.ndarray, list[str]]:
    """The members that are single code points, as a mask over code points, and those that are longer."""
    mask = np.zeros(0x110000, bool)
    longer = []
    for members in classes():
        for m in members:
            if len(m) == 1:
                mask[ord(m)] = True
                other = m.swapcase()
                if len(other) == 1:
                    mask[ord(other)] = True
            elif m:
                longer.append(m)
    return mask, longer


class MemberCounter:
    """Counts look-alike strings in batches of texts. It holds at most one number per member of the classes, a number
    fixed by Unicode, whatever the size of the data."""

    _MARKED = re.compile(r".[\u0300-\u036f]+")
    _BEYOND = re.compile(r"[^\x00-\x7f]+")

    def __init__(self) -> None:
        self.total = np.zeros(0x110000, np.int64)
        mask, longer = _counted()
        self.mask, self.known = mask, set(longer)
        self.ligated = [m for m in longer if m.isascii() and m.isalpha()]
        self.strings: dict[str, int] = {}

    def add(self, texts: list) -> None:
        text = "\n".join(x for x in texts if x)
        # one byte each counts ASCII; the rest is rare and picked out
        self.total[:128] += np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)[:128]
        rest = "".join(self._BEYOND.findall(text))
        got = np.bincount(np.frombuffer(rest.encode("utf-32-le", "surrogatepass"), np.uint32), minlength=0x370)
        self.total[: len(got)] += got
        for m in self.ligated:
            self._count(m, text.count(m))
        if got[0x300:0x370].any():
            for m in self._MARKED.findall(text):
                if m in self.known:
                    self._count(m, 1)

    def _count(self, member: str, n: int) -> None:
        if n:
            self.strings[member] = self.strings.get(member, 0) + n

    def counts(self) -> dict[str, int]:
        return {chr(c): int(self.total[c]) for c in np.flatnonzero((self.total > 0) & self.mask) if not 0xD800 <= c < 0xE000} | self.strings

    def packed(self) -> bytes:
        return json.dumps(self.counts()).encode()

    def merge(self, packed: bytes) -> None:
        for m, n in self.unpacked(packed).items():
            if len(m) == 1:
                self.total[ord(m)] += n
            else:
                self._count(m, n)

    @staticmethod
    def unpacked(packed: bytes | None) -> dict[str, int]:
        return json.loads(packed) if packed else {}


def count_members(df: DataFrame, column: str) -> dict[str, int]:
    """How often each look-alike string occurs in all rows of a text column."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MemberCounter()
        for batch in batches:
            counter.add(batch.column(0).to_pylist())
        found = counter.counts()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["member", "n"])

    counts = mapped(spread(df.select(column)), count, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))
    return {r.member: r.n for r in counts.collect()}


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Every member that isn't its class's representative, with that representative: the most frequent member, upper
    and lower case counted together so that both cases of a letter are represented in one script. Ties: ASCII first,
    then the shorter string, then code point order. A class that holds the empty string is represented by it."""
    out = {}
    for members in classes():
        if "" in members:
            best = ""
        else:
            def weight(m: str):
                other = m.swapcase()
                return -(counts.get(m, 0) + (counts.get(other, 0) if other != m else 0)), not m.isascii(), len(m), m
            best = min(members, key=weight)
        out |= {m: best for m in members if m != best}
    return out


class Form:
    """The rewriting of text to its consistent form. Holds only strings, so it travels to the executors."""

    def __init__(self, to: dict[str, str]) -> None:
        self.to = to
        self._ready = None

    def __getstate__(self):
        return {"to": self.to, "_ready": None}

    def _make(self):
        automaton = ahocorasick.Automaton()
        # every member holds its trigger, so matches lie around triggers, as near as the longest such member reaches
        reach: dict[str, int] = {}
        for m, best in self.to.items():
            automaton.add_word(m, (len(m), best))
            trigger = next((c for c in m[::-1] if not c.isascii()), m[0])
            reach[trigger] = max(reach.get(trigger, 0), len(m) - 1)
        automaton.make_automaton()
        # Two classes: one with characters beyond the first plane would lose its bitmap and be searched item by item.
        first = "".join(map(re.escape, sorted(c for c in reach if c <= "\uffff")))
        self._ready = automaton, re.compile(f"[{first}]|[\U00010000-\U0010ffff]"), reach, not any(c.isascii() for c in reach)
        return self._ready

    def __call__(self, text: str) -> str:
        """``text`` in the consistent form. Rewriting repeats, as a removed or replaced character may bring others
        together, until nothing changes. Should representatives lead back to an earlier text, the smallest text of that
        circle is the form, whichever of them it is reached from."""
        ready = self._ready or self._make()
        if ready[3] and text.isascii():
            return text
        passed: list[str] = []
        while (new := self._pass(text, *ready[:3])) != text:
            if new in passed:
                return min([*passed[passed.index(new):], text])
            passed.append(text)
            text = new
        return text

    def _pass(self, text: str, automaton, trigger: re.Pattern, reach: dict[str, int]) -> str:
        """One rewriting of a text, leftmost longest match first, searched for around its triggers only."""
        spans: list[list[int]] = []
        for m in trigger.finditer(text):
            far = reach.get(m[0])
            if far is None:
                continue
            at = m.start()
            begin, end = max(at - far, 0), at + far + 1
            if spans and begin < spans[-1][1]:
                spans[-1][1] = max(end, spans[-1][1])
            else:
                spans.append([begin, end])
        if not spans:
            return text
        out, last = [], 0
        for begin, end in spans:
            piece = text[begin:end]
            best = self.to.get(piece)
            if best is not None:
                out += [text[last:begin], best]
                last = min(end, len(text))
                continue
            for at, (length, best) in automaton.iter_long(piece):
                out += [text[last : begin + at + 1 - length], best]
                last = begin + at + 1
        return "".join(out) + text[last:] if last else text


def learned(df: DataFrame, column: str) -> Form:
    """The form whose representatives are those most frequent in all rows of a text column."""
    return Form(representatives(count_members(df, column)))


def formed(scan: Callable[[Form], DataFrame], name: str) -> tuple[DataFrame, Form]:
    """The rows of ``scan(form)`` as a written table, and the form most frequent in the texts that it read.

    Besides its own rows, a scan yields rows of :data:`MEMBERS` with the look-alike strings it met, so that one pass
    over the texts does both. It begins with the form that Unicode alone suggests; should the corpus be written
    otherwise, the pass is repeated with the form that it shows. At most one count per member comes to the driver."""
    form = Form(representatives({}))
    while True:
        rows = cut(scan(form), name)
        counts = rows.filter("member is not null").groupBy("member").agg(F.sum("member_n").alias("n")).collect()
        shown = Form(representatives({r.member: r.n for r in counts}))
        if shown.to == form.to:
            return rows, form
        drop_cut(rows)
        form = shown


#: Columns of a scan for :func:`formed`, null in its own rows.
MEMBERS = "member string, member_n long"


_MARKS = re.compile(r"[\u0300-\u036f]")
_WORD = re.compile(r"\w+(?:[.,](?<=\d[.,])(?=\d)\w+)*")
_MARKED_WORD = re.compile(r"[\w\u0300-\u036f]+(?:[.,](?<=\d[.,])(?=\d)[\w\u0300-\u036f]+)*")


class PerToken(dict):
    """What a function gives for a token between blanks, kept as long as tokens are few and short. Texts repeat most of
    theirs, so that looking them up is cheaper than searching the text."""

    def __init__(self, function: Callable[[str], object]) -> None:
        super().__init__()
        self.function = function

    def __missing__(self, token: str):
        got = self.function(token)
        if len(token) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[token] = got
        return got


def _words_of(token: str) -> tuple[str, ...]:
    return tuple((_MARKED_WORD if _MARKS.search(token) else _WORD).findall(token.replace("_", " ")))


_tokens = PerToken(_words_of)


def words(text: str) -> list[str]:
    """The unbroken runs of letters and digits of a text in consistent form, in lower case and in order. A point or
    comma between two digits belongs to the number. Superscripts, fractions and accents are part of words."""
    return list(itertools.chain.from_iterable(map(_tokens.__getitem__, text.lower().split())))


def letters_digits(text: str) -> str:
    """The letters and digits of a text in consistent form, in lower case and in order, all else dropped."""
    return "".join(words(text))
