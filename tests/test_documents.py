import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quirespark.operators import chunks as C
from quirespark.operators import layout as Y
from quirespark.operators import lines as L
from quirespark.operators import runs as R
from quirespark.operators import structure as S
from quirespark.plans.pipeline import Pipeline
from quirespark.sources import files as A


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, t string")


@pytest.mark.parametrize(
    "size, pct, snap, text, want",
    [(10, 20, True, "aaaa bbbb cccc dddd", [(0, 9), (7, 14), (12, 19), (17, 19)]), (5000, 20, False, "x" * 12000, [(0, 5000), (4000, 9000), (8000, 12000), (11000, 12000)]), (5, 0, True, "", [])],
)
def test_chunk_bounds(size, pct, snap, text, want):
    assert C.bounds(text, size, pct, snap) == want


def test_chunks(spark):
    c = C.chunks(texts(spark, "x" * 12000, None, ""), "id", "t", 5000, 20, False)
    assert C.totals(c).collect()[0].asDict() == {"id": 0, "n_chunks": 4, "total_overlap": 3000, "average_size": 3750}
    assert C.chunks(texts(spark, "x" * 50), "id", "t", 10, 0, False, max_chunks=2).count() == 2
    with pytest.raises(ValueError):
        C.chunks(texts(spark, "x"), "id", "t", 0)


def test_join_lines(spark):
    got = L.join_lines(texts(spark, "Das ist ein Bei-\nspiel ohne Ende\nmit Schluß!\n\nNeuer Absatz.", None), "id", "t").orderBy("paragraph_no").collect()
    assert [r["text"] for r in got] == ["Das ist ein Beispiel ohne Ende mit Schluß!", "Neuer Absatz."]
    assert (got[0]["joined"], got[0]["hyphens"]) == (2, 1)


def test_line_operators_on_edge_cases(spark):
    t = texts(spark, "1. One\n1. Two\nAnna: hello\n12 Siehe dort\n- item\n    deep", None, "", " \n ")
    assert {r["type"] for r in L.headers(t, "id", "t").collect()} >= {"chapter"}
    assert L.dialogues(t, "id", "t").collect()[0]["speaker"] == "Anna"
    assert {r["type"] for r in L.paragraph_types(t, "id", "t").collect()} == {"numbered", "bulleted", "indented", "regular"}
    q = {r["id"]: r for r in L.structure_quality(t, "id", "t").collect()}
    assert set(q) == {0, 2, 3} and q[2]["score"] == 70
    for f in (L.join_lines, L.segments, L.headers, L.footnotes, L.features, L.structure_quality, L.needs_joining):
        assert f(t.limit(0), "id", "t").count() == 0


def test_structure(spark):
    e = spark.createDataFrame([("b", 0, "1. A"), ("b", 1, "1.1.1 B"), ("b", 2, "§1 x"), ("b", 3, "P4 y"), ("b", 4, "1. A"), ("b", 5, None)], "book_key string, idx int, entry string")
    assert sorted(r["missing"] for r in S.missing_numbers(e).collect()) == [2, 3]
    assert [r["toc_level"] for r in S.classify(e).orderBy("idx").collect()][:2] == [2, 3]
    assert {(r["idx"], r["warning"]) for r in S.warnings(e).collect()} == {(2, "paragraph_short"), (3, "paragraph_short"), (4, "duplicate"), (5, "blank")}
    df = spark.createDataFrame([("A b c", "a b d"), ("x", "X "), ("", "y")], "a string, b string")
    assert [r[0] for r in df.select(S.similarity(F.col("a"), F.col("b"))).collect()] == [pytest.approx(2 / 3, abs=1e-6), 1.0, 0.0]


GOOD = json.dumps({"matchedEntries": [], "newEntries": [{"text": "Chapter 3: Conclusion", "position": "after index 1", "confidence": 0.8}], "corrections": [{"index": 1, "original": "Chapter 2", "corrected": "Chapter 2: Main Content", "confidence": 0.9}], "confidence": 0.88})


def test_model_answers(spark):
    p = S.parse_responses(spark.createDataFrame([("a", 0, GOOD), ("b", 0, GOOD), ("b", 1, GOOD), ("c", 0, GOOD), ("c", 1, "broken")], "book_key string, chunk_no int, j string"), "j")
    s = spark.createDataFrame([(k, ["Chapter 1: Introduction", "Chapter 2"]) for k in "abc"], "book_key string, structure array<string>")
    got = {r["book_key"]: r["structure"] for r in S.apply_responses(s, p).collect()}
    assert got["a"] == ["Chapter 1: Introduction", "Chapter 2: Main Content", "Chapter 3: Conclusion"]
    assert len(got["b"]) == 4
    conf = {r["book_key"]: r["confidence"] for r in S.merged_confidence(p).collect()}
    assert conf == {"a": 0.88, "b": 0.88, "c": 0.44}


def line(spark, *rows):
    return spark.createDataFrame([("d", 1, i, t, float(a), 0.0, float(b), 1.0, 90.0) for i, (t, a, b) in enumerate(rows)], "doc_id string, page_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")


def test_clusters(spark):
    x = line(spark, ("a", 100, 400), ("b", 100, 350), ("c", 50, 300), ("d", 100, 450))
    par = [(r["min_x0"], r["n"], r["average_width"], r["max_width"]) for r in Y.clusters(x).orderBy("cluster").collect()]
    assert par == [(50.0, 1, 300.0, 300.0), (100.0, 3, pytest.approx(283.333333), 350.0)]
    own = [(r["min_x0"], r["average_width"], r["max_width"]) for r in Y.clusters(x, parity=False).orderBy("cluster").collect()]
    assert own == [(50.0, 250.0, 250.0), (100.0, 300.0, 350.0)]
    assert Y.metrics(x).collect()[0]["metrics"][0]["type"] == "paragraph-text"


@pytest.mark.parametrize("x0, x1, want", [(1140, 1340, True), (1090, 1390, False), (50, 250, False), (1127.5, 1352.5, True)])
def test_centring(spark, x0, x1, want):
    df = spark.createDataFrame([(float(x0), float(x1))], "a double, b double")
    assert df.select(Y.line_centred(F.col("a"), F.col("b"), F.lit(250.0))).first()[0] is want


@pytest.mark.parametrize(
    "text, pattern, want",
    [
        ("X WISSEN UND HANDELN IM LICHTE DER DENKWEISE", "{roman-number} {title-in-capital-letters}{no-paragraph-end-marker}", True),
        ("X WISSEN und HANDELN", "{roman-number} {title-in-capital-letters}{no-paragraph-end-marker}", False),
        ("I EINLEITUNG", "{roman-number} {title-in-capital-letters}{no-paragraph-end-marker}", True),
        ("WISSEN UND HANDELN", "{title-in-capital-letters}", True),
        ("DER DENKVWEISE 1. Methodologie", "{title-in-capital-letters}", False),
        ("5", "{title-in-capital-letters}", True),
        ("18. August 1787", "{title-with-decimal-number}", False),
        ("5. Ethische und historische Wissenschaften", "{title-with-decimal-number}", True),
        ("ERSTER VORTRAG Dornach, 12. September 1921", "{german-ordinal} VORTRAG {place}, {long-date}", False),
        ("erster VORTRAG Bad Boll, 12. September 1921", "{german-ordinal} VORTRAG {place}, {long-date}", True),
        ("erster VORTRAG DORNACH, 12. September 1921", "{german-ordinal} VORTRAG {place}, {long-date}", False),
        ("Bad-Boll am Wald", "{place}", False),
    ],
)
def test_header_patterns(spark, text, pattern, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(Y.match_header(F.col("t"), pattern)[0]).first()[0] is want


def test_header_values(spark):
    df = spark.createDataFrame([("1. Methodologie",)], "t string")
    assert df.select(Y.match_header(F.col("t"), "{decimal-number}. {title}")[1]).first()[0] == {"decimal-number": "1", "title": "Methodologie"}


def test_page_fold():
    rows = [("I", 1200, 1250), ("EINLEITUNGAm 18. August des Jahres", 100, 500), ("X", 1200, 1250), ("WISSEN UND HANDELN", 100, 500), ("1. Meth", 1200, 1300), ("Wir haben das Verhältnis", 100, 500)]
    t, a, b = zip(*rows)
    text, foot = Y.fold_page(list(t), list(a), list(b), ["paragraph-text"] * 6, 400.0)
    assert text == "\n\n# I\n\n EINLEITUNGAm 18. August des Jahres\n\n# X\n\n\n\n# WISSEN UND HANDELN\n\n\n\n## 1. Meth\n\n Wir haben das Verhältnis"
    assert foot == ""
    assert Y.fold_page(["12 Siehe dort", "x"], [0, 0], [1, 1], ["paragraph-text", "footnote-start"], 0.0)[0] == "12 Siehe dort x"
    assert Y.glue("foo-", "bar") == "foobar" and Y.glue("foo-", "Bar") == "foo- Bar"


def test_page_fold_by_book_type(spark, tmp_path):
    x = line(spark, ("Chapter {number}", 1200, 1250), ("  Das ist ein Wort-  ", 100, 500), (" teil des Ganzen ", 100, 500), ("ERSTES BUCH", 1100, 1380))
    pages = x.union(x.withColumn("doc_id", F.lit("e"))).union(x.withColumn("doc_id", F.lit("none")))
    types = spark.createDataFrame([("d", "werk"), ("e", "ebook"), ("f", "x")], "doc_id string, book_type string")
    got = {r["doc_id"]: r["text"] for r in Y.fold_pages(pages, types).collect()}
    assert got["e"].startswith("\n\n# Chapter {number}\n\n") and "Das ist ein Wortteil des Ganzen ERSTES BUCH" in got["e"]
    assert "# ERSTES BUCH" in got["d"] and "#" not in got["none"]
    (tmp_path / "types.json").write_text(json.dumps({"ebook": {"header-type": {"level1": {"formats": ["Das ist ein Wort-"]}}, "metrics": {"paragraph-text": 0, "quote-text": 200}, "text-removal-patterns": ["/x+/"]}, "bare": None}))
    config = A.book_types(str(tmp_path / "types.json"))
    assert config["ebook"]["offsets"] == {"quote-text": (200.0, 15.0)} and config["bare"]["headers"] == [[], [], []] and "default" in config
    got = {r["doc_id"]: r["text"] for r in Y.fold_pages(pages, types, config).collect()}
    assert "#" not in got["d"] and "# Das ist" not in got["e"]  # a header does not go on in small letters
    df = spark.createDataFrame([("ebook", "axxb"), ("other", "xx"), (None, "x"), ("ebook", None)], "book_type string, t string")
    out, n = Y.remove_by_type(df, "t", config)
    assert [tuple(r) for r in df.select(out, n).collect()] == [("ab", 1), ("xx", 0), ("x", 0), (None, None)]


def test_lines_without_box_and_raised_marks(spark):
    x = line(spark, ("a", 100, 400), ("b", 100, 400)).withColumn("x0", F.when(F.col("line_no") == 0, F.col("x0")))
    assert [r["text"] for r in Y.fold_pages(x).collect()] == ["a"]
    sym = {"text": "1", "bbox": {"x0": 0, "y0": 50, "x1": 1, "y1": 70}, "baseline": {"x0": 0, "y0": 0, "x1": 0, "y1": 100, "has_baseline": True}}
    words = [{"text": "1a", "bbox": {"x0": 0, "y0": 50, "x1": 1, "y1": 100}, "symbols": [sym]}]
    w = spark.read.schema(Y.OCR_SCHEMA).json(spark.sparkContext.parallelize([json.dumps({"doc_id": "d", "page_no": 1, "paragraphs": [{"lines": [{"text": "1a", "bbox": {"x0": 100, "y0": 0, "x1": 400, "y1": 1}, "words": words}, {"text": "b", "bbox": {"x0": 100, "y0": 0, "x1": 400, "y1": 1}, "words": []}]}]})]))
    lines = Y.flatten(w)
    assert [r["line_type"] for r in Y.line_types(lines, Y.metrics(lines)).orderBy("line_no").collect()] == ["footnote-start", "paragraph-text"]


def test_merge_of_matches(spark):
    one = lambda c, t: json.dumps({"matchedEntries": [{"originalIndex": 1, "correctedText": t, "confidence": c, "position": 2}], "newEntries": [], "corrections": [], "confidence": 0.5})
    p = S.parse_responses(spark.createDataFrame([("a", 0, one(0.5, "x")), ("a", 1, one(0.7, "y")), ("a", 2, one(0.7, "z")), ("a", 3, "no")], "book_key string, chunk_no int, j string"), "j")
    assert [tuple(r) for r in S.merge_matches(p).collect()] == [("a", 1, "y", 2, 0.7)]


def test_fold_pages_takes_nulls_and_repeats(spark):
    x = line(spark, (None, 100, 200), ("Text", 100, 200))
    got = Y.fold_pages(x.union(x)).collect()
    assert len(got) == 1 and got[0]["text"].strip() == "Text"
    assert Y.fold_pages(x.limit(0)).count() == 0


def test_pages_join_across_buckets(spark):
    n = 3 * Y.BUCKET
    rows = [("b", p, None if p % 7 == 0 else f"p{p}-" if p % 2 else "x") for p in range(n)] + [("b", 1, "p1-")]
    got = Y.join_pages(spark.createDataFrame(rows, "book_key string, page_no int, text_with_headers string"))
    pieces = {r["page_no"]: r["piece"] for r in got.collect()}
    full = sorted(p for p in range(n) if p % 7)
    assert sorted(pieces) == full
    assert all(pieces[p] == (f"p{p}" if p % 2 else "x ") for p in full[:-1])


def test_markers(spark):
    pages = spark.createDataFrame([("b", 1, "front"), ("b", 2, "START here"), ("b", 3, "one"), ("b", 4, "the END"), ("b", 5, "back"), ("c", 1, "x"), ("c", 2, None)], "book_key string, page_no int, text_with_headers string")
    m = spark.createDataFrame([("b", "START", "END"), ("c", None, None)], "book_key string, text_before string, text_after string")
    assert sorted(map(tuple, Y.inside_markers(pages, m).collect())) == [("b", 3), ("b", 4), ("c", 1), ("c", 2)]


def test_footnote_mark(spark, tmp_path):
    sym = lambda t, y0, y1: {"text": t, "bbox": {"x0": 0, "y0": y0, "x1": 1, "y1": y1}, "baseline": {"x0": 0, "y0": 0, "x1": 0, "y1": 100, "has_baseline": True}}
    word = {"text": "12a", "bbox": {"x0": 0, "y0": 50, "x1": 1, "y1": 100}, "symbols": [sym("1", 50, 70), sym("2", 50, 70), sym("a", 60, 100)]}
    page = {"doc_id": "d", "page_no": 1, "paragraphs": [{"lines": [{"text": "12a", "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}, "words": [word]}, {"text": "b", "words": []}]}, {"text": "no lines"}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    lines = Y.flatten(A.recognised_pages(spark, str(tmp_path)))
    assert [r[0] for r in lines.select(Y.footnote_mark(F.col("words"))).collect()] == ["12", ""]


def test_runs(spark):
    e = spark.createDataFrame([("a", "done", 1.0), ("a", None, 2.0), ("b", "x", None)], "k string, s string, v double")
    got = {r["k"]: (r["n"], r["n_done"], r["success_rate"]) for r in R.roll_up(e, "k", "s", "v", "done").collect()}
    assert got == {"a": (2, 1, 0.5), "b": (1, 0, 0.0)}
    assert R.most_common(e, "k").first()["k"] == "a"
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1)], "i int, f string, g int")
    b = spark.createDataFrame([(1, "x", 2), (3, "z", 1)], "i int, f string, g int")
    assert sorted(map(tuple, R.drift(a, b, "i", ["f", "g"]).collect())) == [(1, "both", "g"), (2, "old", "*"), (3, "new", "*")]


def test_pipeline(spark):
    p = Pipeline().register("a", "A", lambda df: df.filter("id > 0")).register("b", "B", lambda df: df.limit(1))
    assert p.run(texts(spark, "x", "y"), enabled=["a"]).count() == 1
    assert [r["status"] for r in p.log_frame(spark).collect()] == ["completed", "pending"]
    bad = Pipeline().register("a", "A", lambda df: df.select("missing"))
    with pytest.raises(Exception):
        bad.run(texts(spark, "x"))
    assert bad.log[0][3] == "failed"


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_bytes("ä".encode("latin-1"))
    assert A.plain_text(spark, str(tmp_path / "t")).first()["text"] == "ä"
    assert A.file_info(spark, str(tmp_path / "t")).first()["mime"] == "text/plain"
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package><metadata><title>T</title></metadata><manifest><item id="1" href="1.html"/></manifest><spine><itemref idref="1"/><itemref idref="none"/></spine></package>')
        z.writestr("O/1.html", "<h1>One</h1><p>a &amp; b</p>")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    got = A.epub(spark, str(tmp_path)).collect()
    assert [(r["title"], r["author"], r["chapter_title"], r["text"]) for r in got] == [("T", "Unknown", "One", "Onea & b")]
    m = spark.createDataFrame([("k", "A", "T", "1", None, "end", ["x", "y"])], "book_key string, author string, title string, book_index string, text_before string, text_after string, book_structure array<string>")
    back = A.manifest_fields(A.manifest_yaml(m)).first()
    assert (back["author"], back["text_before"], back["text_after"], back["book_structure"]) == ("A", None, "end", ["x", "y"])
    A.write_texts(spark.createDataFrame([("k", 1, "t")], "book_key string, n int, t string"), str(tmp_path / "out"))
    assert A.read_texts(spark, str(tmp_path / "out"), ["k"]).columns == ["book_key", "n", "t"]
    assert [A.read_texts(spark, str(tmp_path / "out"), k).count() for k in (None, ["k", "z"], ["z"], [])] == [1, 1, 0, 0]


def test_streaming(spark, tmp_path):
    from quirespark.streaming.pages import running_books

    src = tmp_path / "pages"
    spark.createDataFrame([("b", 1, "abc"), ("b", 2, None), ("c", 1, "x")], "book_key string, page_no int, text string").write.parquet(str(src))
    q = running_books(spark.readStream.schema("book_key string, page_no int, text string").parquet(str(src))).writeStream.outputMode("update").format("memory").queryName("books").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM books").collect())) == [("b", 2, 3, 2), ("c", 1, 1, 1)]
