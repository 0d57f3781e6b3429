"""Operators against brute force and worked cases, and their results for nulls, empty tables, ties and odd columns."""

import difflib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import folds, graph, inserts, layout, similarity
from quillspark.operators import paragraphs as P
from quillspark.operators.store import Store
from quillspark.sources import files
from quillspark.streaming.ingest import first_seen

SCHEMA = "id long, content string, document_id long, paragraph_type string, para_position int, header_content string, column_no int"


def paragraphs(spark, rows):
    return spark.createDataFrame([(i, c, d, k, n, None, col) for n, (i, c, d, k, col) in enumerate(rows)], SCHEMA)


def values(spark, texts, column):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.v for r in df.select("k", column.alias("v")).orderBy("k").collect()]


def test_exact_key(spark):
    assert values(spark, ["Hello,  World!", "a , b", "  (Été)  ÇA va. ", "...", None], T.exact_key("t")) == ["hello world", "a  b", "été ça va", "", None]


def test_headers(spark):
    texts = ["1.2 Introduction", "TERMS OF USE", "Annual Report For The Year", "Short note", "This is a longer run of words without stop", "Ends with dot.", ""]
    assert values(spark, texts, T.is_header("t")) == [True, True, True, True, False, False, False]


def test_sizes_and_pages(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (2621440,), (5 * 1024**5,)], "n long")
    assert [r[0] for r in df.select(T.size_text("n")).collect()] == ["0.00 B", "1023.00 B", "1.00 KB", "2.50 MB", "5120.00 TB"]
    df = spark.createDataFrame([(7500, 1, 0), (10500, 1, 0), (0, 0, 0)], "c int, n int, k int")
    assert [r[0] for r in df.select(T.estimated_pages("c", "n", "k")).collect()] == [2, 4, 1]


def test_scores(spark):
    pairs = [("The quick brown fox jumps", "Quick brown foxes jump", 0.333333, 0.851064), ("alpha beta gamma delta epsilon", "alpha beta gamma delta zeta", 0.666667, 0.842105),
             ("the of and", "of the", 0.0, 0.375), ("abc", "abcdef", 0.0, 0.5), ("kitten sitting", "sitting kitten", 1.0, 0.5), ("   ", "   ", 0.0, 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, d7 double, d8 double")
    df = similarity.text_scores(df, "a", "b")
    for r in df.select("d7", "d8", F.round(T.jaccard(T.word_set("a"), T.word_set("b")), 6).alias("x"), F.round("text_score", 6).alias("y")).collect():
        assert (r.x, r.y) == (r.d7, r.d8)


def chunk_share(a, b):
    """The chunk overlap of two texts, worked out text by text."""
    short, long = sorted((a, b), key=len)
    size = min(100, len(short) // 2)
    parts = [short[k : k + size] for k in range(0, len(short), size // 2)]
    return min(1.0, sum(len(c) for c in parts if len(c) >= 20 and c in long) / len(short))


def test_text_scores_of_long_texts(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n)).strip() or "x"
    base = text(1500)
    pairs = [(base, base[:700] + text(900)), (base, base[200:900] + "q"), (base, text(80)), (base, "short one"), (text(300), text(310)), (None, base), ("", base), (base, base), (base, base[:700] + text(900))]
    rows = [(k, a, b, 0.5) for k, (a, b) in enumerate(pairs)]
    got = {r.k: r.text_score for r in similarity.text_scores(spark.createDataFrame(rows, "k int, content1 string, content2 string, text double")).collect()}
    for k, (a, b) in enumerate(pairs):
        if not a or not b:
            expected = 0.0
        elif a.strip() in b.strip() or b.strip() in a.strip():
            expected = min(len(a.strip()), len(b.strip())) / max(len(a.strip()), len(b.strip()))
        elif max(len(a.strip()), len(b.strip())) > 1000 and min(len(a), len(b)) >= 40:
            expected = chunk_share(a.strip(), b.strip())
        else:
            expected = difflib.SequenceMatcher(None, a.strip(), b.strip()).ratio()
        assert got[k] == pytest.approx(expected)
    assert similarity.text_scores(spark.createDataFrame([], "content1 string, content2 string")).count() == 0


def test_scores_of_many_texts_with_one_second_text():
    rng = random.Random(9)
    text = lambda letters, n: "".join(rng.choices(letters, k=n)).strip() or "x"
    score = similarity._Scorer()
    for letters in ("abcdefgh ", ".|&_-!? ", "abcdefghijklmnopqrstuvwxyz0123456789 "):
        for n in (12, 90, 199, 200, 350, 1000):
            second = text(letters, n)
            for x in [text(letters, rng.randint(10, n)) for _ in range(6)] + [second[: n // 2] + "q" + second[n // 2 + 3 :], second[3:] + "zz"]:
                if x not in second and second not in x and max(len(x), len(second)) <= 1000:
                    assert score(x, second) == difflib.SequenceMatcher(None, x, second).ratio()


def test_full_search_scores_pairs_of_one_class(spark):
    # contents without other words than _ and __ are all alike, and each pair is wanted
    rng = random.Random(10)
    texts = [" ".join(["_", *("".join(rng.choices("|&%$#~", k=5)) for _ in range(40)), "__"]) for _ in range(30)]
    rows = paragraphs(spark, [(k, t, k, "normal", None) for k, t in enumerate(texts)] + [(50, "Exact copy, here", 1, "normal", None), (51, "exact copy here", 2, "normal", None)])
    got = {(r.id_a, r.id_b): (r.content_score, r.text_score, r.kind) for r in similarity.full_search(rows).collect()}
    ratio = lambda a, b: max(0.01, difflib.SequenceMatcher(None, texts[a], texts[b]).ratio())
    assert got == {(a, b): (1.0, ratio(a, b), "similar") for a in range(30) for b in range(a + 1, 30)} | {(50, 51): (1.0, 1.0, "exact")}


def test_exact_classes(spark):
    rows = paragraphs(spark, [(1, "Hello, World!", 1, "normal", None), (2, "hello world", 2, "normal", None), (3, "Hello World", 1, "normal", None), (4, "a , b", 3, "normal", None), (5, "a b", 4, "normal", None), (6, None, 5, "normal", None), (7, "", 6, "normal", None), (8, "hello world", None, "normal", None)])
    got = {r.id: (r.class_id, r.copies, r.links) for r in similarity.exact_classes(rows).collect()}
    assert got == {1: (1, 3, 1), 2: (1, 3, 2), 3: (1, 3, 1)}
    assert similarity.exact_classes(rows.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_prefix_join(spark, threshold):
    rng = random.Random(4)
    sets = {k: sorted(set(rng.choices("abcdefghijkl", k=rng.randint(1, 9)))) for k in range(120)} | {500: []}
    df = spark.createDataFrame(list(sets.items()), "id long, items array<string>")
    got = {(r.id_a, r.id_b) for r in similarity.prefix_join(df, None, threshold).collect()}
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0
    assert got == {(a, b) for a in sets for b in sets if a < b and share(sets[a], sets[b]) >= threshold - 1e-12}


@pytest.mark.parametrize("chance", [0, 2, 10])
def test_few_sets_of_common_items_meet(spark, monkeypatch, chance):
    # every word is in hundreds of sets, so sets that shared one rare word were all candidates: 300 times as many as alike
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    sets = {k: rng.sample(words, rng.randint(8, 16)) for k in range(900)}
    sets |= {1000 + k: sets[k][1:] + ["x"] * (k % 2) for k in range(100)} | {2000: ["w1"], 2001: ["w1"]}
    counts = {}
    monkeypatch.setattr(similarity, "CHANCE_BITS", chance)
    monkeypatch.setattr(similarity, "cut", lambda df, name, of=similarity.cut: counts.setdefault(name, []).append(df.count()) or of(df, name))
    df = spark.createDataFrame(list(sets.items()), "id long, items array<string>")
    got = {(r.id_a, r.id_b) for r in similarity.prefix_join(df, None, 0.8).collect()}
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert got == {(a, b) for a in sets for b in sets if a < b and share(sets[a], sets[b]) >= 0.8} and len(got) >= 60
    assert counts["pairs-that-met"][0] <= 3 * len(got)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_values_miss_no_pair_of_any_size(threshold):
    import numpy as np

    rng = np.random.default_rng(8)
    for size in (1, 2, 3, 4, 5, 9, 40, 95, 96, 119, 120, 121, 511, 512, 600, 640):
        for _ in range(6):
            one = rng.choice(4000, size, False)
            kept = one[: max(1, int(np.ceil(size * (threshold + (1 - threshold) * rng.random()))))]
            two = np.append(kept, 5000 + np.arange(rng.integers(0, 3)))
            if len(kept) / len(np.union1d(one, two)) < threshold:
                continue
            rarity = rng.integers(0, 20, similarity.SLOTS).astype(np.uint8)
            h = similarity._mix(np.concatenate([one, two]).astype(np.uint64) + np.uint64(1))
            owner, value, skip = similarity._first_shared(h, np.array([0, size]), np.array([size, len(two)]), rarity, 30, threshold)
            assert set(value[owner == 0]) & set(value[owner == 1]) and (skip >= 0).all()


def test_words_and_keys_read_once_are_those_of_the_text_functions(spark):
    odd = ["Hello,  World! x_y", "\u00c9t\u00e9 \u2028 \u00a0 na\u00efve's (\u0130stanbul)", "\u039f\u0394\u039f\u03a3 \u03a3\u0391\u03a3. 12\u00bd", "the of and to in", "_ __ |&_ !_?", "  , . ;  :  ! ?  ", "short", "a\u000bb\u001cc\u0085d tail of it", "e\u0301a \u0e01\u0e34 combining", None, ""]
    rows = paragraphs(spark, [(k, t, 1, "normal", None) for k, t in enumerate(odd)] + [(99, "of no document", None, "normal", None)])
    got = {r.id: (r.key, r.words) for r in similarity._worded(rows).collect()}
    told = rows.filter("document_id is not null and content is not null").withColumn("key", T.exact_key("content")).select(
        "id", F.when(F.col("key") != "", P.digest("key")).alias("key"), F.when(F.length("content") >= 10, T.word_set("content")).alias("w"))
    assert got == {r.id: (r.key, " ".join(sorted(r.w)) if r.w else None) for r in told.collect()}


def test_lsh_is_subset_of_similar(spark, sf_dir):
    found = similarity.lsh_pairs(spark.read.parquet(f"{sf_dir}/paragraphs.parquet"), 0.8).collect()
    assert all(r.id_a < r.id_b and 0.8 <= r.estimate <= 1 for r in found)


def test_components(spark):
    results = spark.createDataFrame([(1, 1, 2, 0.9), (2, 3, 2, 0.8), (3, 4, 5, 0.95), (4, 5, 6, 0.79), (5, 7, 7, 1.0), (6, 4, 5, None)], "id long, paragraph1_id long, paragraph2_id long, content_similarity_score double")
    links = graph.edges(results, 0.8)
    assert {r.id: r.component for r in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in graph.components(chain).collect()} == {0}
    assert graph.components(chain.limit(0)).count() == 0


def test_communities_split_components(spark):
    clique = lambda v: [(a, b, 1.0) for a in v for b in v if a < b]
    links = spark.createDataFrame(clique([1, 2, 3, 4]) + clique([5, 6, 7, 8]) + [(4, 5, 1.0)], "a long, b long, weight double")
    got = {r.id: r.community for r in graph.communities(links, graph.components(links)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 5}


def test_inserts(spark):
    page = "terms and conditions apply to every order here"
    pages = spark.createDataFrame([(1, 10, page), (1, 11, page + " now"), (2, 12, page), (2, 13, "")], "insert_id long, page_id long, content string")
    documents = spark.createDataFrame([(1, 7, page), (2, 7, page), (3, 8, "nothing of the kind at all")], "page_id long, document_id long, content string")
    found = inserts.page_matches(pages, documents)
    assert {(r.insert_page, r.document_id, r.document_page) for r in found.collect()} == {(10, 7, 1), (11, 7, 1), (12, 7, 1)}
    assert {(r.insert_id, r.document_id) for r in inserts.insert_matches(pages, found).collect()} == {(1, 7)}


def test_collapse_and_references(spark):
    rows = paragraphs(spark, [(1, "x", 1, "normal", None), (2, "x", 2, "normal", None), (3, "y", 2, "normal", None), (4, None, 2, "normal", None), (5, None, 2, "normal", None)])
    documents = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf")], "doc_id long, filename string")
    assert [r.id for r in P.collapsed(rows.filter("content is not null")).filter("document_id = 2").collect()] == [3]
    assert {(r.class_id, r.id, r.filename, r.occurrences) for r in P.references(rows, documents).collect()} == {(1, 1, "a.pdf", 2), (1, 2, "b.pdf", 2), (3, 3, "b.pdf", 1)}
    assert {(r.class_id, r.id) for r in P.duplicate_groups(rows, documents).collect()} == {(1, 1), (1, 2)}
    assert P.statistics(documents, rows).first().asDict() == {"total_documents": 2, "total_paragraphs": 5, "unique_paragraphs": 2, "duplicate_paragraphs": 1}
    assert P.statistics(documents.limit(0), rows.limit(0)).first().total_paragraphs == 0


def test_headers_and_runs(spark):
    kinds = [("H1", "header"), ("H2", "header"), ("p1", "normal"), ("p2", "normal"), ("H3", "header"), ("p3", "normal"), ("a", "list"), ("b", "list"), ("c", "table")]
    rows = paragraphs(spark, [(k, c, 1, kind, None) for k, (c, kind) in enumerate(kinds)])
    assert {r.content: r.header for r in P.headed(rows).collect() if r.header} == {"p1": "H2", "p3": "H3"}
    assert {(r.content, r.merged) for r in folds.merged_runs(rows).collect() if r.merged > 1} == {("a\nb", 2)}
    assert [r.sequence for r in P.positions(rows).orderBy("id").collect()] == list(range(9))
    assert P.headed(rows.limit(0)).count() == 0 and folds.merged_runs(rows.limit(0)).count() == 0


def test_page_and_tags(spark):
    assert P.page_bounds(101, 9, 25) == (5, 5) and P.page_bounds(0, 0, 25) == (1, 1)
    tags = spark.createDataFrame([(1, "Header", "#fff")], "id long, tag_name string, color string")
    assert sorted(r.tag_name for r in P.with_default_tags(tags).collect()) == sorted(n for n, _ in P.DEFAULT_TAGS)


def test_folds(spark):
    assert list(folds.attached([(1, "normal", "intro:", None), (2, "list", "a", None), (3, "list", "b", None), (4, "list", "c", None)])) == [(1, "normal", "intro:\na"), (2 + 1, "list", "b\nc")]
    assert list(folds.packed(["a" * 2000, "b" * 1500, "c" * 4000, "d"])) == ["a" * 2000, "b" * 1500, "c" * 4000, "d"]
    assert folds.split_long("no sentence here") == ["no sentence here"]
    text = "One sentence here. " * 40
    assert "".join(folds.split_long(text)).replace(" ", "") == text.replace(" ", "")
    rows = paragraphs(spark, [(1, "intro:", 1, "normal", None), (2, "a", 1, "list", 1), (3, "z", 2, "normal", None)])
    assert {(r.id, r.content) for r in folds.attach_elements(rows).collect()} == {(1, "intro:\na"), (3, "z")}


@pytest.mark.parametrize("stretch", [1, 3, 7, 20_000])
def test_pages_are_packed_alike_in_stretches_of_any_length(spark, stretch):
    rng = random.Random(stretch)
    rows = paragraphs(spark, [(k, "x" * rng.choice([1, 4, 9, 31]), rng.choice([1, 1, 1, 2, None]), "normal", None) for k in range(80)] + [(900, " ", 1, "normal", None), (901, None, 1, "normal", None)])
    held = {}
    for r in rows.orderBy("para_position", "id").collect():
        if r.content and r.content.strip():
            held.setdefault(r.document_id, []).append(r.content)
    expected = {(d, k, p) for d, c in held.items() for k, p in enumerate(folds.packed(c, 30))}
    assert {tuple(r) for r in folds.packed_pages(rows, 30, stretch).collect()} == expected
    assert folds.packed_pages(rows.limit(0)).count() == 0


def test_attached_in_segments(spark):
    rng = random.Random(3)
    rows = paragraphs(spark, [(k, rng.choice(["a:", "b", "c: "]) + str(k % 5), rng.choice([1, 1, 2]), rng.choice(["normal", "list", "list", "table", None]), rng.choice([None, 1, 2])) for k in range(150)])
    rows = rows.withColumn("content", F.when(F.col("id") % 3 == 0, F.concat("content", F.lit(":"))).otherwise(F.col("content")))
    held = {}
    for r in rows.orderBy("para_position", "id").collect():
        held.setdefault(r.document_id, []).append((r.id, r.paragraph_type, r.content, r.column_no))
    assert {tuple(r) for r in folds.attach_elements(rows).collect()} == {(d, *x) for d, c in held.items() for x in folds.attached(c)}


def test_large_components_are_split_by_distributed_moves(spark):
    rng = random.Random(5)
    groups = [range(k, k + 12) for k in range(0, 60, 12)]
    pairs = {(a, b) for g in groups for a in g for b in g if a < b and rng.random() < 0.8} | {(g[0], h[0]) for g, h in zip(groups, groups[1:])}
    links = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, weight double")
    got = {r.id: r.community for r in graph.communities(links, graph.components(links), most_links=10).collect()}
    assert got == {v: g[0] for g in groups for v in g}


def test_hot_bands(spark):
    # many contents of one signature band, dealt into blocks; contents without items meet nobody
    rows = [(k, f"the very same words stand in this line number {k}", k % 5, "normal", None) for k in range(60)] + [(200 + k, "the of and to in", k, "normal", None) for k in range(30)]
    whole = {(r.id_a, r.id_b) for r in similarity.lsh_pairs(paragraphs(spark, rows), 0.5).collect()}
    assert whole and {(r.id_a, r.id_b) for r in similarity.lsh_pairs(paragraphs(spark, rows), 0.5, hot=4).collect()} == whole
    assert all(a < 200 and b < 200 for a, b in whole)


def test_differences(spark):
    rows = [(1, 10, "the same words"), (1, 11, "the same words"), (1, 12, "quite another"), (1, 13, None), (2, 20, "word " * 400), (2, 21, "word " * 399 + "end")]
    got = {r.id: (r.equal_percent, r.bucket) for r in similarity.differences(spark.createDataFrame(rows, "cluster_id long, id long, content string")).collect()}
    assert got[10] == got[11] == (100.0, "high") and got[12][1] == "low" and got[13] == (0.0, "low") and 99 < got[21][0] < 100


def test_layout(spark):
    cells = lambda x, n: [(1, 0, k, x, 20.0 * k, x + 100, 20.0 * k + 15, 600.0, 800.0, "word " * 30) for k in n]
    df = spark.createDataFrame(cells(50.0, range(8)) + cells(400.0, range(20, 28)) + [(1, 0, 99, None, None, None, None, 600.0, 800.0, None)], "document_id long, page_no long, block_no long, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, content string")
    assert [r.several for r in layout.several_columns(df).collect()] == [True]
    assert [(r.from_x, r.to_x) for r in layout.column_bounds(df).orderBy("column_no").collect()] == [(0.0, 150.0), (400.0, 600.0)]
    rects = spark.createDataFrame([(1, 0, 40.0, 0.0, 160.0, 55.0)], "document_id long, page_no long, x0 double, y0 double, x1 double, y1 double")
    assert {r.block_no for r in layout.outside_tables(df, rects).collect()} == {*range(3, 8), *range(20, 28), 99}
    assert layout.column_bounds(df.limit(0)).count() == 0 and layout.several_columns(df.limit(0)).count() == 0


def test_contents_and_names(spark):
    raw = [("Title", "header", None, 1), ("Contents", "unknown", None, None), ("One .... 1", "unknown", None, None), ("", "unknown", None, None), ("Two .... 12", "unknown", None, None), ("Text", "unknown", None, None), ("Three .... 3", "unknown", None, None)]
    assert files.table_of_contents(raw) == [(1, "Contents", "toc"), (2, "One .... 1", "toc_entry"), (4, "Two .... 12", "toc_entry")]
    assert files.table_of_contents(raw[2:]) == []
    names = spark.createDataFrame([(1, "scan.pdf"), (2, "scan.pdf"), (3, "scan.pdf"), (4, "plain"), (5, None), (6, "plain")], "n long, filename string")
    assert {r.n: r.stored for r in files.stored_names(names, "n", "T").collect()} == {1: "scan.pdf", 2: "scan_T.pdf", 3: "scan_T_2.pdf", 4: "plain", 6: "plain_T"}


def docx(body):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    head = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>'
    cells = "<w:tbl><w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>" for x in "ab") + "</w:tr></w:tbl>"
    (tmp_path / "a.docx").write_bytes(docx(head + "<w:p><w:r><w:t>Text</w:t></w:r></w:p>" + cells))
    (tmp_path / "b.txt").write_text("one\n\ntwo")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    rows = files.parsed(files.scan_folder(spark, str(tmp_path))).collect()
    got = {(r.path.rsplit("/", 1)[1], r.position): (r.content, r.paragraph_type, r.level) for r in rows if r.error is None}
    assert got == {("a.docx", 0): ("Title", "header", 2), ("a.docx", 1): ("Text", "unknown", None), ("a.docx", 2): ("a | b", "table", None), ("b.txt", 0): ("one", "unknown", None), ("b.txt", 1): ("two", "unknown", None)}
    assert {r.path.rsplit("/", 1)[1] for r in rows if r.error} == {"c.docx", "d.pdf"}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("tags", spark.createDataFrame([(1, "a")], "id long, tag_name string"))
    store.append("tags", spark.createDataFrame([("b",), ("c",)], "tag_name string"))
    assert {(r.id, r.tag_name) for r in store.read("tags").collect()} == {(1, "a"), (2, "b"), (3, "c")}
    store.upsert("tags", spark.createDataFrame([(1, "z")], "id long, tag_name string"), "id")
    assert {(r.id, r.tag_name) for r in store.read("tags").collect()} == {(1, "z"), (2, "b"), (3, "c")}
    assert store.clear("tags").count() == 0


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("Hello, World!", "2024-01-01 00:00:00"), ("hello world", "2024-01-01 00:01:00"), ("other", "2024-01-01 00:02:00")], "content string, at string").selectExpr("content", "cast(at as timestamp) as at").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("content string, at timestamp").parquet(source)
    query = first_seen(stream, "at").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select * from seen").count() == 2
