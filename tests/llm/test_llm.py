"""Training-text operators against brute force, round trips and held-out accuracy, and on odd input."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import copies, leaks, links, mixing, near, quality, queries, scans
from quillspark.session import cut
from quillspark.llm.form import Form, MemberCounter, classes, letters_digits, representatives, words

FORM = Form(representatives({}))
SCHEMA = "id long, content string, document_id long, paragraph_type string, para_position int, header_content string, column_no int, key int, n int, raw string"
TALL = "The parties agree that the warden and the revised trainee form part of file number one two three four five "


def table(spark, rows):
    """Paragraphs (id, content, document, kind, header), with columns whose names operators use inside."""
    return spark.createDataFrame([(i, c, d, k, n, h, None, 1, 2, "r") for n, (i, c, d, k, h) in enumerate(rows)], SCHEMA)


# --- consistent form (3) -------------------------------------------------------------------------------------------------

def test_form():
    pairs = [("Nоvember", "November"), ("ｆｕｌｌ－１２", "full-12"), ("ﬁle oﬀ", "file off"), ("été", "été"), ("a​́", "á"), ("ӓ", "ä"),
             ("a b c d", "a b c d"), ("ki­t", "kit"), ("kit­\nchen", "kit-\nchen"), ("re‐use", "re-use"), ("ΤΗΕ", "THE"), ("", "")]
    for a, b in pairs:
        assert FORM(a) == b
    for kept in ("m²", "½", "5 – 6", "été", "a\tb\n", "…", "“x”"):
        assert FORM(kept) == kept


def test_form_in_all_planes():
    invisible = [*map(chr, range(0xE0020, 0xE0080)), "\U000e0001", "\U000e0100", "\U000e01ef", "\ufe0f"]
    assert FORM("a" + "".join(invisible) + "b") == "ab"
    for code in (0x2F800, 0x2FA1D):
        assert FORM(chr(code)) == unicodedata.normalize("NFC", chr(code))
    assert FORM("Ⅳ ⅻ") == "IV xii" and FORM("ﬃ") == "ffi"


def test_form_ends_in_circles():
    # representatives that lead back to one another: each text of the circle has the same form
    form = Form({"ab": "cd", "cd": "ab"})
    assert form("ab") == form("cd") and form(form("xaby")) == form("xcdy")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
def test_form_is_idempotent(text):
    assert FORM(FORM(text)) == FORM(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abeoxü éÖ.,-1", max_size=30), st.randoms())
def test_form_undoes_dirt(text, rng):
    alike = {}
    for members in classes():
        for m in members:
            if len(m) == 1:
                alike.setdefault(FORM(m), []).append(m)
    dirty = "".join(rng.choice(alike.get(c, [c])) for c in unicodedata.normalize(rng.choice(["NFC", "NFD"]), text))
    assert FORM(dirty) == FORM(text)


def test_representatives_follow_frequency():
    assert Form(representatives({"а": 900, "А": 90, "a": 3}))("a") == "а"
    counter = MemberCounter()
    counter.add(["aaа", None, "é fi"])
    assert {k: counter.counts()[k] for k in ("a", "а", "é", "fi")} == {"a": 2, "а": 1, "é": 1, "fi": 1}


def test_words():
    assert words("A total of 56,405.11 EUR, m² (½) x_y 3.") == ["a", "total", "of", "56,405.11", "eur", "m²", "½", "x", "y", "3"]
    assert letters_digits("T4-17,5. Été!") == "t417,5été"


# --- copies (5), same print (3), best representative (1) -----------------------------------------------------------------------

def keyed(rows):
    return copies.keyed(cut(copies.fields(rows, FORM), "fields").filter("row is not null"))


def test_copies(spark):
    rows = table(spark, [
        (5, TALL, 1, "normal", None), (9, TALL.upper() + "!", 2, "list", "H"), (7, " ".join(TALL), 3, "normal", " "), (8, TALL.replace("a", "а"), 1, "normal", None),
        (30, TALL + "once more", 1, "normal", None), (30, TALL + "once more", 1, "normal", None),
        (1, "x " * 20, 1, "normal", None), (2, None, 1, "normal", None), (3, "", None, None, None), (4, "short", 1, "normal", None),
        (20, "a" * 30 + "|" + "b" * 30, 1, "table", None), (21, "b" * 30 + "\n\n" + "a" * 30 + " | ", 2, "table", None), (22, "a" * 30 + "|" + "b" * 30, 3, "normal", None)])
    keys = keyed(rows)
    assert {(r.group_id, r.id) for r in copies.members(keys).collect()} == {(5, 5), (5, 9), (5, 7), (5, 8), (20, 20), (20, 21)}
    assert {(r.paragraph_a, r.paragraph_b) for r in copies.printed_alike(keys).collect()} == {(5, 8)}
    assert copies.groups(keyed(rows.limit(0))).count() == 0


def test_number_points_count(spark):
    rows = table(spark, [(1, TALL + "62,103.88", 1, "normal", None), (2, TALL + "62,10388", 1, "normal", None), (3, TALL + "62,103.88.", 1, "normal", None)])
    assert {r.id for r in copies.members(keyed(rows)).collect()} == {1, 3}


def test_short_contents_of_long_forms_and_cells(spark):
    # 25 ligatures of three letters are 75 letters; cells are told by their own integers, however often they stand
    rows = table(spark, [(1, "\ufb03" * 25, 1, "normal", None), (2, "ffi" * 25, 2, "normal", None), (3, "ffi" * 25 + "x", 2, "normal", None),
                         (10, "|".join(["a" * 30, "b" * 30, "b" * 30]), 1, "table", None), (11, "|".join(["b" * 30, "a" * 30, "b" * 30]), 1, "table", None),
                         (12, "|".join(["b" * 30, "a" * 30, "a" * 30]), 1, "table", None), (13, "|".join(["a" * 30, "b" * 30]), 1, "table", None), (14, "|".join(["a" * 30, "b" * 30, "c" * 30]), 1, "table", None)])
    assert {(r.group_id, r.id) for r in copies.members(keyed(rows)).collect()} == {(1, 1), (1, 2), (10, 10), (10, 11)}


def test_best(spark):
    rows = spark.createDataFrame([(1, 5, 10), (1, 6, 30), (1, 4, 30), (2, 8, None), (2, 9, None)], "group_id long, id long, at long")
    got = copies.best(rows, "group_id", [F.col("at").desc_nulls_last(), F.col("id")])
    assert {(r.group_id, r.id) for r in got.collect()} == {(1, 4), (2, 8)}


def test_best_limits_groups_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, 5, 10)], "group_id long, id long, at long")
    plan = copies.best(rows, "group_id", [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# --- near duplicates (4) -----------------------------------------------------------------------------------------------------------

def edited(rng, text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    texts = {}
    for base in range(60):
        text = " ".join(f"x{rng.randrange(3000)}" for _ in range(rng.choice([16, 30, 60, 130])))
        for k in range(4):
            texts[base * 10 + k] = edited(rng, text, 0.08 * k)
    rows = table(spark, [(i, t, 1, "normal", None) for i, t in texts.items()] + [(9000, None, 1, None, None), (9001, "", 1, None, None), (9002, texts[0], 2, "normal", None)])
    scan = near.Scan(rows)
    ids = dict(scan.rows.select("words_id", "id").groupBy("words_id").agg(F.min("id")).collect())
    got = {tuple(sorted((ids[r.words_a], ids[r.words_b]))) for r in near.similar_sets(scan).collect()}
    sets = {i: set(words(t)) for i, t in texts.items()}
    sets = {i: s for i, s in sets.items() if len(s) >= 15 and sum(map(len, words(texts[i]))) >= 60}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] != sets[b] and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b])}
    assert near.similar_sets(near.Scan(rows.limit(0))).count() == 0


def test_versions_that_fill_the_corpus(spark):
    rng = random.Random(8)
    base = [f"word{k}" for k in range(40)]
    texts = {k: " ".join([f"own{k}", *base[:k % 3], *base[k % 3 + 1:]]) for k in range(50)} | {100 + k: " ".join(f"z{rng.randrange(9000)}" for _ in range(30)) for k in range(60)}
    scan = near.Scan(table(spark, [(i, t, 1, "normal", None) for i, t in texts.items()]))
    assert near.similar_sets(scan).count() == 50 * 49 // 2


def hashed_sets(sets):
    """(hashes, starts) of sets of numbers, one after another."""
    flat = np.array([x for s in sets for x in sorted(s)], np.uint64)
    return near._mix(flat + np.uint64(1)), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)


@pytest.mark.parametrize("bits", [0.0, 6.0, 12.0])
@pytest.mark.parametrize("total,shared", [((18, 18), 16), ((20, 20), 18), ((22, 23), 20), ((15, 15), 14), ((16, 20), 16), ((36, 45), 36), ((60, 60), 54), ((400, 460), 383), ((2000, 2000), 1778)])
def test_bands_miss_no_similar_pair(total, shared, bits):
    # at the threshold, whatever words differ and however frequent they are
    rng = random.Random(sum(total) + shared)
    sets = []
    for k in range(300 if sum(total) < 200 else 12):
        x = rng.sample(range(10**9), total[0] + total[1] - shared)
        sets += [set(x[: total[0]]), set(x[:shared] + x[total[0]:])]
    assert all(len(a & b) * 10 >= 8 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    hashes, starts = hashed_sets(sets)
    owner, values = near.bands(hashes, np.full(len(hashes), bits), 2.0**20, starts)
    held = {}
    for o, v in zip(owner.tolist(), values.tolist()):
        held.setdefault(o, set()).add(v)
    assert all(held[k] & held[k + 1] for k in range(0, len(sets), 2))


def test_near_pairs_of_short_sets_and_common_words(spark):
    # 400 unrelated pairs of short sets with two words replaced, and versions that share common words only and differ in rare fills
    rng = random.Random(3)
    texts = {}
    for k in range(400):
        x = [f"short{rng.randrange(10**6)}" for _ in range(24)]
        texts[2 * k], texts[2 * k + 1] = " ".join(x[:20]), " ".join(x[:18] + x[20:22])
    common = [f"common{k}" for k in range(60)]
    for k in range(200):
        own = rng.sample(common, 36)
        for j in range(2):
            texts[10_000 + 2 * k + j] = " ".join(own + [f"fill{rng.randrange(10**6)}" for _ in range(3)])
    scan = near.Scan(table(spark, [(i, t, 1, "normal", None) for i, t in texts.items()]))
    ids = dict(scan.rows.select("words_id", "id").collect())
    got = {tuple(sorted((ids[r.words_a], ids[r.words_b]))) for r in near.similar_sets(scan).collect()}
    sets = {i: set(words(t)) for i, t in texts.items()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b])}


def labels(df):
    return scans.labelled(scans.with_recurrence(scans.lines(scans.scanned(df, FORM))))


def split(df):
    return scans.split_words(labels(df), scans.word_counts(scans.scanned(df, FORM)))


def test_misread_words_of_lists_without_function_words(spark):
    # the corpus knows the words of a parts list; those of an invented text it doesn't, whichever way its rows are found
    parts = "washer gasket bearing flange bracket spindle bushing coupler manifold impeller gearbox housing".split()
    rng = random.Random(4)
    rows = [(k, f"the {' and the '.join(parts)} of pump {k}", 1, "normal", None) for k in range(20)]
    rows += [(100, "; ".join(["gask3t", "be4ring", "wa5her", *parts[1:]]), 1, "list", None), (101, " ".join(["wa5her", *("".join(rng.choices("bcdfghklmnprtvz", k=7)) for _ in range(20))]), 1, "normal", None)]
    df = table(spark, rows)
    counts = scans.word_counts(scans.scanned(df, FORM))
    hidden = counts.withColumn("ids", F.expr("case when word is null then ids end"))
    for some in (counts, hidden):
        assert {(r.id, r.word, r.reading) for r in scans.misread(df, some, FORM)[0].collect()} == {(100, "wa5her", "washer")}


def test_misread_words_with_many_ones(spark, monkeypatch):
    rows = [(k, "invisibility illimitability initialising", 1, "normal", None) for k in range(9)] + [(100, "1nv1s1b1l1ty", 1, "normal", None), (101, "1111m1tab1l1ty", 1, "normal", None), (102, "1n1t1al1s1nq", 1, "normal", None), (103, "1n1t1a11s1ny", 1, "normal", None), (104, "invisi1i1i1y1 1nv151b111fy", 1, "normal", None)]
    got = {(r.word, r.reading) for r in scans.misread_words(scans.word_counts(scans.scanned(table(spark, rows), FORM))).collect()}
    assert got == {("1nv1s1b1l1ty", "invisibility"), ("1111m1tab1l1ty", "illimitability"), ("1nv151b111fy", "invisibility")}
    # the folded forms give what listing all readings gives
    for word in ("1l1i1c1", "1i11rn1", "c11111f"):
        monkeypatch.setattr(scans, "MOST_ONES", 9)
        listed = set(scans.readings(word))
        monkeypatch.setattr(scans, "MOST_ONES", 0)
        assert listed == {w for w in listed if any(f == w.replace("i", "l") and re.fullmatch(p, w) for f, p in scans.open_readings(word))}


def test_split_words_in_consistent_form(spark):
    ends = ["-\n", "-\u00a0\n", "-\u200b\n", "\ufe63\n", "\uff0d\n", "\u2010 \n", "\u00ad\n", "-\u2003\n\u2003"]
    rows = [(k, f"the agree{e}ment holds", 1, "normal", None) for k, e in enumerate(ends)]
    rows += [(20, "the cafe\u0301-\nteria", 1, "normal", None), (21, "the x\u0323-\nray\u0301s", 1, "normal", None), (30, "from 5-\n7 and é", 1, "normal", None), (31, "end -\nnext é", 1, "normal", None), (32, "agree ment", 1, "normal", None), (33, None, 1, None, None)]
    df = table(spark, rows)
    assert {r.id for r in split(df).collect()} == {*range(len(ends)), 20, 21}


def test_hot_values_are_dealt_into_blocks(spark):
    # one band value for all sets, met in blocks of three, gives the pairs that it gives in one run
    rng = random.Random(6)
    base = [f"base{k}" for k in range(40)]
    texts = {k: " ".join([*rng.sample(base, 38), f"own{k}"]) for k in range(40)}
    scan = near.Scan(table(spark, [(i, t, 1, "normal", None) for i, t in texts.items()]))
    fresh = scan.rows.filter("size(hashes) > 0")
    whole = {tuple(r) for r in near.candidates(fresh, scan.rarity, scan.sets).collect()}
    assert len(whole) > 100 and {tuple(r) for r in near.candidates(fresh, scan.rarity, scan.sets, hot=3).collect()} == whole


def test_odd_sketch_estimates():
    rng = np.random.default_rng(5)
    errors = []
    for shared in (80, 90, 100):
        for _ in range(40):
            h = rng.integers(0, 1 << 63, 200 - shared, dtype=np.uint64)
            own = (len(h) - shared) // 2
            a, b = h[: shared + own], np.concatenate([h[:shared], h[shared + own:]])
            flips = np.unpackbits(near.sketch(a, np.array([0])) ^ near.sketch(b, np.array([0]))).sum()
            true = shared / len(h)
            errors.append(near.similarity(flips) - true)
            assert true < 0.8 or flips <= near.most_flips()
    assert abs(np.mean(errors)) < 0.03


# --- groups of links (6) -----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(1001, 1060)] + [(k, k + 1) for k in range(2000, 2060)] + [(5, 5), (None, 3)]
    label = {}
    for a, b in pairs:
        if a is not None and a != b:
            for v in (a, b):
                label.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a is not None and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    df = spark.createDataFrame(pairs * 2, "a long, b long")
    assert {r.v: r.group_id for r in links.components(df).collect()} == label
    assert links.components(df.limit(0)).count() == 0


def test_components_without_broadcasts(spark):
    pairs = [(1000, k) for k in range(1001, 1060)] + [(k, k + 1) for k in range(2000, 2030)] + [(1, 2), (3, 2)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.v: r.group_id for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
    assert got == {1: 1, 2: 1, 3: 1} | {k: 1000 for k in range(1000, 1060)} | {k: 2000 for k in range(2000, 2031)}


# --- scan noise (7) -------------------------------------------------------------------------------------------------------------------

def test_readings():
    assert "dossiers" in scans.readings("d0ssiers") and "team" in scans.readings("tearn") and "enabled" in scans.readings("enab1ed")
    assert not scans.readings("b2") and not scans.readings("2017") and not scans.readings("x77y")


def test_noise(spark):
    prose = "The warden will inspect the valve and the parties agree to the notice in writing before the end of the month"
    rows = [(k, f"{prose} {chr(97 + k % 26)}.", 1 + k % 7, "normal", None) for k in range(40)]
    rows += [(100, "Annual Valve Report v3", 50, "header", None), (101, "Annual Valve Report v3    Page 4 of 9", 50, "normal", None), (102, "- 7 -", 50, "footer", None),
             (103, f"{prose} and the war-\nden signs it.", 50, "normal", None), (104, prose.replace("notice", "n0tice"), 51, "normal", None), (105, "Spare Harbour", 50, "heading", None),
             (106, None, 50, None, None), (107, "", 50, "normal", None), (108, f"{prose}\nANNUAL VALVE REPORT V3\nand so on.", 50, "normal", None)]
    df = table(spark, rows)
    counts = scans.word_counts(scans.scanned(df, FORM))
    assert {r.id for r in split(df).collect()} == {103}
    assert {(r.id, r.word, r.reading) for r in scans.misread(df, counts, FORM)[0].collect()} >= {(104, "n0tice", "notice")}
    found = {r.id for r in labels(df).collect() if r.headers}
    assert found == {100, 101, 102, 108}
    assert labels(df.limit(0)).count() == 0


def test_running_titles_of_any_length(spark):
    long = "Annual Report of the Board on Valves and Pumps of the Northern and Southern Works and their Housings"
    other = "the warden will inspect the valve before the end of the month and\nthe parties agree to it in writing"
    rows = [(k, long, 1, "normal", None) for k in range(3)] + [(10 + k, f"Rules\n{other} {k}.", 2, "normal", None) for k in range(3)] + [(20, "Draft (internal)", 3, "normal", None), (21, "DRAFT (internal)  ·  Page 2", 3, "normal", None)]
    # copies of a paragraph, and rows of tables, repeat their lines without a title among them
    rows += [(30 + k, f"{other}\nand no more is said of it.", 4, "normal", None) for k in range(3)] + [(40 + k, f"Item | Due\n{k} | {k + 1}", 5, "table", None) for k in range(3)] + [(50, long, 6, "normal", None)]
    assert {r.id for r in labels(table(spark, rows)).collect() if r.headers} == {0, 1, 2, 10, 11, 12, 20, 21}


def test_words_split_around_headers(spark):
    # the model leaves out the running title between the two parts of a word
    rows = [(k, "Annual Valve Report", 1, "header", None) for k in range(3)] + [(10, "the war-\nAnnual Valve Report\nden signs", 1, "normal", None), (11, "a gas-\n- 7 -\nket holds", 1, "normal", None), (12, "one val-\n\n", 1, "normal", None)]
    assert {r.id for r in split(table(spark, rows)).collect()} == {10, 11}


def test_repair():
    text = "The valve was re-\npaired by the\nANNUAL REPORT V3\ncrew yesterday.\nIt is n0w open."
    assert scans.repaired(text, [2], [3], {"n0w": "now"}) == "The valve was repaired by the crew yesterday.\nIt is now open."


# --- leaks (8) ----------------------------------------------------------------------------------------------------------------------------

def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"word{k}" for k in range(30)] + ["1,234.5", "été"]
    items = {k: " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 30]))) for k in range(12)}
    texts = {}
    for d in range(80):
        w = items[rng.randrange(12)].split()
        a = rng.randrange(len(w))
        texts[d] = "So. " + rng.choice([" ", "\n", " – "]).join(w[a: a + rng.randrange(1, 30)]).upper() + " the end"
    texts |= {900: None, 901: ""}
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    held = spark.createDataFrame([*items.items(), (99, None), (98, "")], "item_id long, text string")
    found = leaks.leaks(documents, held, FORM).collect()

    def runs(x, y):
        return {" ".join(y[k: k + 12]) for k in range(len(y) - 11)} & {" ".join(x[k: k + 12]) for k in range(len(x) - 11)}

    assert {(r.doc_id, r.item_id) for r in found} == {(d, i) for d, t in texts.items() for i, x in items.items() if t and runs(words(t), words(x))}
    for r in found:
        assert len(words(texts[r.doc_id][r.from_char: r.to_char])) == r.n_words
    assert leaks.leaks(documents.limit(0), held, FORM).count() == 0 and leaks.leaks(documents, held.limit(0), FORM).count() == 0


def test_leak_blocks(spark):
    held = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(6)], "item_id long, text string")
    parts = list(leaks.blocks(held, FORM, most=10))
    assert len(parts) > 2 and sum(map(len, parts)) == 6 * 9


# --- mixing (9) ------------------------------------------------------------------------------------------------------------------------------

def test_flow_meets_quotas():
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4)}
    patterns = {("a",): 1000, ("b",): 200, ("a", "b"): 100, ("c",): 60}
    plan = mixing.planned(patterns, targets)
    got = {s: sum(v for (p, x), v in plan.items() if x == s) for s in targets}
    total = sum(got.values())
    assert all(abs(got[s] / total - w) < 0.01 for s, (w, _) in targets.items())
    assert all(v <= patterns[p] * targets[s][1] for (p, s), v in plan.items())
    # the small source is the limit: it is repeated as often as it may be
    assert got["c"] == 240 and not mixing.routed(patterns, targets, total + 10)[1]


def test_flow_is_cheapest():
    # two ways of cost 1 and 3: the cheap one fills first
    assert mixing.min_cost_flow(4, [(0, 2, 5, 1), (0, 3, 5, 3), (2, 1, 9, 0), (3, 1, 9, 0), (0, 1, 2, 0)], 0, 1) == [5, 5, 5, 5, 2]


def test_mixed(spark):
    rng = random.Random(1)
    rows = [(k, "one two three four " * rng.randrange(1, 9) + f"n{k}", rng.choice("aaaab")) for k in range(600)] + [(1000, None, "a"), (1001, "", "b"), (1002, "x", None), (1003, "alone", "z")]
    rows += [(2000, "shared text of both", "a"), (2001, "shared text of both", "b")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("t"))
    mix = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen = mixing.mixed(documents, mix).toPandas()
    assert set(chosen.source) == {"a", "b"} and chosen[chosen.source == "a"].copies.max() == 1 and chosen[chosen.source == "b"].copies.max() <= 3
    share = (chosen.tokens * chosen.copies).groupby(chosen.source).sum()
    assert abs(share["a"] / share.sum() - 0.6) < 0.02
    again = mixing.mixed(documents.repartition(7), mix).toPandas()
    assert sorted(map(tuple, again.values)) == sorted(map(tuple, chosen.values))
    assert mixing.mixed(documents.limit(0), mix).count() == 0 and mixing.mixed(documents, mix.limit(0)).count() == 0


def test_every_document_is_a_record(spark):
    rows = [(k, f"text number {k} of the first source", "a") for k in range(40)] + [(100 + k, "one text many times over", "a") for k in range(5)] + [(200, "one text many times over", "b"), (201, "of b alone", "b")]
    counted = mixing.token_counts(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    every, once = mixing.units(counted).collect(), mixing.units(counted, once=True).collect()
    assert {r.doc_id for r in every} == {r[0] for r in rows} and {r.doc_id for r in once} == {r[0] for r in rows} - {101, 102, 103, 104}
    # the first document of each source shares a unit with that of the other
    unit = {r.doc_id: r.unit for r in every}
    assert unit[100] == unit[200] and len(set(unit.values())) == len(rows) - 1


# --- quality (10) --------------------------------------------------------------------------------------------------------------------------------

def test_rules_separate():
    rng = np.random.default_rng(0)
    x = pd.DataFrame(rng.random((600, len(quality.FEATURES))), columns=quality.FEATURES)
    kinds = np.where(x.list_share > 0.7, "list", np.where(x.table_share > 0.8, "table", "prose"))
    noisy = kinds.copy()
    noisy[::60] = "junk"
    rules = quality.induce(x, noisy)
    held = pd.DataFrame(rng.random((400, len(quality.FEATURES))), columns=quality.FEATURES)
    got, open_ = np.full(400, rules[-1][0], dtype=object), np.ones(400, bool)
    for kind, rule in rules[:-1]:
        hit = quality._covers(rule, held) & open_
        got[hit], open_ = kind, open_ & ~hit
    assert (got == np.where(held.list_share > 0.7, "list", np.where(held.table_share > 0.8, "table", "prose"))).mean() > 0.95
    assert quality.as_sql([("prose", [])]) == "'prose'" and quality.as_sql(rules).startswith("CASE WHEN")


def test_wide_cells_and_long_runs(spark):
    wide = " ".join(["the pump of the second line was taken out of use"] * 3)
    texts = [f"{wide} | {wide}\n{wide} | {wide}", f"{wide}\t{wide}\t{wide}", f"{wide}; {wide}; {wide}", "aGVsbG8gd2Ugd2FpdCBhIG1vbWVudCBvZiBhZ2U=\nYWJhIGVjaG8gaWRvIGFnbyBlYXUgb2FlIGl1"]
    got = {r.doc_id: r for r in quality.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].table_share > 0.9 and got[1].table_share > 0.9 and got[2].table_share == 0
    assert got[3].long_share > 0.9 and got[3].junk_share > 0.9 and got[0].long_share == 0


def test_statistics(spark):
    df = spark.createDataFrame([(1, "- one item\n- two items\n- more"), (2, "a | b | c\nd | e | f"), (3, None), (4, ""), (5, "The cat sat on the mat. It was not for sale."), (6, "word word word word word word")], "doc_id long, text string").withColumn("n_chars", F.lit("clash"))
    got = {r.doc_id: r for r in quality.statistics(df).collect()}
    assert got[1].list_share > 0.9 and got[2].table_share > 0.9 and got[3].n_chars == 0 == got[4].n_words and got[5].common_words > 0.5 and got[6].junk_share == 1
    assert all(got[4][f] == 0 for f in quality.FEATURES)


def test_words_of_statistics():
    # words as problem 5 has them, in any script; zero-width characters split none
    got = dict(zip(quality._STATISTICS, quality.measured("one - two -- three / four | five", FORM)))
    assert got["n_words"] == 5 and abs(got["mean_word_length"] - 3.8) < 1e-9
    assert quality.measured("straße été nai\u0308ve 3,5 x\u200by", FORM)[1] == 5
    assert quality.measured("д" * 5 + " мир", FORM)[3] == 4


def test_no_labels_is_prose(spark):
    stats = quality.statistics(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    assert quality.learned_rules(stats, spark.createDataFrame([], "doc_id long, kind string")) == [("prose", [])]


def test_held_out_accuracy(spark):
    import os
    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no test data here")
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "doc_labels"))
    rows = quality.statistics(docs.join(labels.select("doc_id"), "doc_id", "left_semi")).join(labels, "doc_id").toPandas().sort_values("doc_id", ignore_index=True)
    half = len(rows) // 2
    rules = quality.induce(rows[quality.FEATURES][:half], rows.kind.to_numpy()[:half])
    rest = rows[half:]
    got, open_ = np.full(len(rest), rules[-1][0], dtype=object), np.ones(len(rest), bool)
    for kind, rule in rules[:-1]:
        hit = quality._covers(rule, rest) & open_
        got[hit], open_ = kind, open_ & ~hit
    assert (got == rest.kind).mean() > 0.93


# --- all queries -------------------------------------------------------------------------------------------------------------------------------------

COLUMNS = {"p1_found": ["group_id", "survivor_id", "header_id"], "p3_found": ["paragraph_a", "paragraph_b"], "p4_found": ["paragraph_a", "paragraph_b"], "p5_found": ["group_id", "paragraph_id"],
           "p6_found": ["group_id", "paragraph_id"], "p7_found": ["paragraph_id", "noise"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "kind"]}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows)
    assert not any(re.match("__", c) for c in df.columns)
