"""Text expressions over columns: normal forms, tokens, classifiers and display formats. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stopwords that word similarity leaves out.
STOPWORDS = """
a an the and or but if then else when at by for with about against between into to from in out on off over under again
further then once here there all any both each few more most other some such no nor not only own same so than too very can
will just should now is are was were be been being have has had having do does did doing this that these those of up down
""".split()
# What white space is beyond ASCII, as a regular expression class for Java and RE2.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_SPACE = "[^" + SPACE[1:]
#: Anything that is neither part of a word nor white space.
NOT_WORD = r"[^\p{L}\p{N}_" + SPACE[1:]
# Punctuation dropped from the key of exact matches.
KEY_PUNCTUATION = r"""[,.;:!?"'()\[\]]"""


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapsed(text) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), f"{SPACE}+", " "))


def exact_key(text) -> Column:
    """The key of exact matches: lower case, blanks collapsed, then punctuation dropped (which may leave two blanks)."""
    return F.trim(F.regexp_replace(collapsed(F.lower(_c(text))), KEY_PUNCTUATION, ""))


def cleaned(text) -> Column:
    """Lower case without punctuation, blanks collapsed."""
    return collapsed(F.regexp_replace(F.lower(_c(text)), NOT_WORD, ""))


def split_words(text) -> Column:
    return F.filter(F.split(_c(text), f"{SPACE}+"), lambda x: x != "")


def tokens(text) -> Column:
    """Words of the cleaned text that are no stopwords, in order."""
    return F.filter(split_words(cleaned(text)), lambda x: ~x.isin(sorted(set(STOPWORDS))))


def word_set(text) -> Column:
    return F.array_distinct(tokens(text))


def shingles(cleaned_text) -> Column:
    """Overlapping runs of three characters of a column of :func:`cleaned` text, two if it has fewer than 30; repeated
    ones stay. It takes a column, as each run would clean the text anew."""
    c = _c(cleaned_text)
    k = F.when(F.length(c) < 30, 2).otherwise(3)
    return F.when(F.length(c) < k, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, k)))


def jaccard(a: Column, b: Column) -> Column:
    """The share of common elements of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_count(text) -> Column:
    return F.size(split_words(text))


def sentence_count(text) -> Column:
    return F.regexp_count(_c(text), F.lit("[.!?]+"))


def is_title(text) -> Column:
    """Every run of letters starts upper case and goes on lower case, and there is one."""
    t = _c(text)
    return t.rlike(r"[\p{Lu}\p{Lt}]") & ~t.rlike(r"[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]") & ~t.rlike(r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}")


def is_upper(text) -> Column:
    t = _c(text)
    return (t == F.upper(t)) & (t != F.lower(t))


def is_header(text) -> Column:
    """Short text without closing punctuation that is numbered, all capitals, title case or of six words at most."""
    t = _c(text)
    short = (F.length(t) <= 100) & (F.length(t) > 0) & ~F.substring(t, -1, 1).isin(*".?!:;,")
    return short & (t.rlike(rf"^[\d.]+{SPACE}+[\p{{L}}\p{{N}}_]") | is_upper(t) | (is_title(t) & (word_count(t) <= 10)) | (word_count(t) <= 6))


_TABLE_ROW = rf"\|[\s\S]*\||\t|[\p{{L}}\p{{N}}_]{SPACE}{{3,}}[\p{{L}}\p{{N}}_]|<tr>|<td>|<th>"
_DIVIDER = r"^\s*\|?\s*[-:]+\s*\|(?:\s*[-:]+\s*\|)*\s*$"
# Bullets, and numbers, letters and roman numerals that mark list items.
LIST_ITEM = r"^\s*(?:[•\-*+○◦➢➣➤►▶→➥➔❖]\s+|\d+[.)]\s+|\([a-z\d]\)\s+|[a-z\d][.)]\s+|[ivxIVX]+[.)]\s+)"
# Parts of addresses, and postcodes of two countries.
ADDRESS_WORDS = ["street", "avenue", "road", "lane", "drive", "boulevard", "st.", "ave.", "rd.", "ln.", "dr.", "blvd.", "suite", "apt", "apartment", "floor", "unit"]
POSTCODE = r"\b[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}\b|\b\d{5}(-\d{4})?\b"
# Phrases of boilerplate.
BOILERPLATE = ["all rights reserved", "copyright", "©", "confidential", "disclaimer", "terms and conditions", "privacy policy", "legal notice", "proprietary", "confidentiality notice", "do not copy", "not for distribution"]


def is_table(text) -> Column:
    return _c(text).rlike(_TABLE_ROW) | _c(text).rlike(_DIVIDER)


# LIST_ITEM in any line of a text, with any blanks but line ends, and something after them: one search instead of one a line
_BLANK = "[" + SPACE[1:-1] + "&&[^\n]]"
_ANY_ITEM = "(?dm)" + LIST_ITEM.replace(r"\s", _BLANK) + NON_SPACE


def has_list_item(text) -> Column:
    return _c(text).rlike(_ANY_ITEM)


def _holds(text, phrases: list[str]) -> Column:
    """Whether a text, in lower case, holds one of some phrases."""
    return F.lower(_c(text)).rlike("|".join("".join(c if c.isalnum() or c in " ©" else "\\" + c for c in p) for p in phrases))


def is_address(text) -> Column:
    return _c(text).rlike(POSTCODE) & _holds(text, ADDRESS_WORDS)


def is_boilerplate(text) -> Column:
    return _c(text).rlike(r"^\s*Page \d+ of \d+\s*$") | _holds(text, BOILERPLATE)


def is_toc_entry(text) -> Column:
    return _c(text).contains("..") & _c(text).rlike(r"\d+\s*$")


def introduces_list(text) -> Column:
    return _c(text).rlike(rf":{SPACE}*$")


def classified(text) -> Column:
    """The kind of an untyped paragraph, tests in order of precedence."""
    return (F.when(is_header(text), "header").when(is_table(text), "table").when(has_list_item(text), "list")
            .when(is_address(text), "address").when(is_boilerplate(text), "boilerplate").otherwise("normal"))


def size_text(size) -> Column:
    """A number of bytes with two decimals and a unit up to TB."""
    v = _c(size).cast("double")
    out = F.format_string("%.2f TB", F.bround(v / 1024.0**4, 2))
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        out = F.when(v < 1024.0 ** (k + 1), F.format_string(f"%.2f {unit}", F.bround(v / 1024.0**k, 2))).otherwise(out)
    return out


def estimated_pages(characters, paragraphs, tables) -> Column:
    """The largest of what characters, paragraphs and tables suggest, rounded half to even, at least 1."""
    return F.bround(F.greatest(_c(characters) / 3000, _c(paragraphs) / 40, _c(tables) / 3, F.lit(1.0)), 0).cast("int")


def truncated(text, most: int) -> Column:
    """At most ``most`` characters, cut at a blank if there is one, with an ellipsis."""
    t = _c(text)
    head = F.substring(t, 1, most)
    at_blank = F.regexp_extract(F.substring(t, 1, most + 1), r"^([\s\S]*) ", 1)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.when(at_blank != "", at_blank).otherwise(head), F.lit("...")))


def cut_hard(text, most: int = 150) -> Column:
    return F.when(F.length(_c(text)) <= most, _c(text)).otherwise(F.concat(F.substring(_c(text), 1, most), F.lit("...")))


def highlighted(text, term: str) -> Column:
    """Every occurrence of ``term``, in any case, between mark tags; an empty term marks nothing."""
    if not term:
        return _c(text)
    return F.regexp_replace(_c(text), "(?i)(" + "".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in term) + ")", "<mark>$1</mark>")


def escaped_html(text) -> Column:
    out = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def heading_level(style) -> Column:
    """The level of a heading by the name of its style, 1 where it names none."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(style), r"Heading\s*(\d+)", 1), F.lit("")).cast("int"), F.lit(1))


def remaining_seconds(total, done, elapsed) -> Column:
    """The time that is left by the mean time of what is done; null before anything is."""
    return F.when(_c(done) > 0, (_c(total) - _c(done)) * _c(elapsed) / _c(done))


def duration_text(seconds) -> Column:
    s = F.round(_c(seconds)).cast("long")
    return (F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60))
            .otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor((s % 3600) / 60))))
