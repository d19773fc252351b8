import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirespark.llm import leakage, lookalikes, mixing, quality, residue, scan_repair, shared_spans, splitting

WORDS = "alder birch cedar delta ember fjord grove haven inlet jetty knoll larch maple north ocean pines quill ridge shore thorn umber vale willow xylem yarrow zephyr".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


# --- problem 1 -----------------------------------------------------------------
TEXTS = [
    (1, "The ropes were in the garden, and the children had not seen them before. There was nothing that they could do about it."),
    (2, "- heavy ropes\n- green gardens\n- small children\n- old harbours\n- wide rivers\n- new lanterns"),
    (3, "| a | 1 |\n|---|---|\n| b | 2 |\n| c | 3 |"),
    (4, None), (5, ""), (6, " \n\t"), (7, "#%&!! ~~ ^^ {{ }} || <> <> ##"),
    (8, "Es war die Zeit, in der die Wege\nnicht mehr so breit waren und auch\nnicht alle durch den Wald gingen."),
    (9, "The garden was large and it had been there for a long time, as they said to us.\n\n- one rope\n- two ropes"),
]


def test_quality_classes(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in TEXTS + TEXTS[:2]], "enhancement_id long, enhanced_text string, text_class string")
    got = {r["enhancement_id"]: r["text_class"] for r in quality.classify(df).collect()}
    assert {k for k, v in got.items() if v == "not_prose"} == {2, 3, 7}
    assert {k for k, v in got.items() if v is None} == {4, 5, 6}
    assert quality.classify(df.limit(0)).count() == 0


def test_statistics_against_python(spark):
    r = random.Random(1)
    rows = [(i, prose(r, 30) + r.choice(["\n- the x", "\n\n|a|b|", "!?"])) for i in range(30)] + [(99, None), (98, "")]
    got = {x["enhancement_id"]: x for x in quality.with_statistics(spark.createDataFrame(rows, "enhancement_id long, enhanced_text string")).collect()}
    for i, t in rows:
        if t is None:
            assert got[i]["n_words"] is None
            continue
        w = re.findall(r"[^\W\d_]+", t.lower())
        assert got[i]["n_words"] == len(w) and got[i]["n_chars"] == len(t)
        assert got[i]["punct_line_share"] == pytest.approx(np.mean([re.search(r"[.!?:;,»”\"'-]\s*$", x) is not None for x in t.split("\n") if x.strip()] or [0]), abs=1e-6)
        assert got[i]["common_share"] == pytest.approx(sum(x in quality.COMMON for x in w) / max(1, len(w)), abs=1e-6)


@pytest.mark.parametrize("held", [quality.labelled(400, seed=99), quality.mixtures(300, seed=98)])
def test_rules_hold_on_held_out_documents(spark, held):
    df = spark.createDataFrame(held, "enhancement_id long, enhanced_text string, y boolean")
    bad = {r[0] for r in quality.found(df).collect()}
    assert np.mean([(i in bad) == y for i, _, y in held]) >= 0.97


def test_stored_rules_are_the_learned_ones(spark):
    assert quality.learn(spark) == quality.RULES and quality.RULES.count("WHEN") > 1


def test_induction_finds_a_threshold():
    x = np.random.default_rng(0).random((600, len(quality.FEATURES)))
    y = x[:, 2] > 0.6
    pred = np.zeros(len(x), bool)
    for rule in quality.induce(x, y):
        pred |= quality.covers(rule, x)
    assert (pred == y).mean() > 0.95
    assert quality.to_sql([]) == "0" and quality.induce(x, np.zeros(len(x), bool)) == []


# --- problem 2 ---------------------------------------------------------------------
def greedy(text, size, overlap):
    """The same cuts, one after the other."""
    kinds, out, e = splitting._ends(text), [], 0
    while not out or e < len(text):
        s = e - overlap if out else 0
        e = int(splitting._successors(np.array([e]), len(text), size, overlap, kinds)[0])
        out.append((s, e))
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abä. \n", min_size=1, max_size=300), st.integers(2, 60), st.integers(0, 99))
def test_split_equals_greedy(text, size, pct):
    overlap = splitting.overlap_of(size, pct)
    got = splitting.cut_points(text, size, overlap)
    assert got == (greedy(text, size, overlap) if len(text) > size else [(0, len(text))])
    assert all(0 < e - s <= size for s, e in got) and got[-1][1] == len(text)
    assert all(a[1] - b[0] == overlap for a, b in zip(got, got[1:]))


def test_splitting_without_boundaries_is_linear():
    import time

    took = []
    for n in (200_000, 1_600_000):
        began = time.perf_counter()
        cuts = splitting.cut_points("x" * n + " y", 100, 20)
        took.append(time.perf_counter() - began)
        assert len(cuts) >= n // 80 and all(e - s <= 100 for s, e in cuts)
    assert took[1] < 8 * 4 * took[0]


def test_newest_delivery_counts(spark):
    rows = [(1, "x" * 30, None, "2020-01-01"), (1, "y" * 25, 1, "2020-01-02"), (2, "x" * 30, 1, "2020-01-01"), (2, "short", 1, "2020-01-02"), (3, "z" * 11, 1, None), (4, "w" * 99, 9, None), (5, "x" * 30, 1, "2020-01-01"), (5, None, 1, "2020-01-05")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, options_id long, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    options = spark.createDataFrame([(1, 10, 20, 2)], "options_id long, chunk_size int, overlap_percentage int, max_chunks int")
    p = splitting.split(chunks, options).collect()
    assert {r["chunk_id"] for r in p} == {1, 3} and {r["content"][0] for r in p if r["chunk_id"] == 1} == {"y"}


def test_split_boundaries_and_edges(spark):
    assert splitting.cut_points("aaa bbb. ccc ddd", 10, 0)[0] == (0, 8)
    assert splitting.cut_points("aaaaaa\n\nbb. bbbb", 10, 0)[0] == (0, 8)
    assert splitting.cut_points("x" * 25, 10, 2) == [(0, 10), (8, 18), (16, 25)]
    chunks = spark.createDataFrame([(1, "x" * 30, None, "q"), (1, "x" * 30, None, "q"), (2, "y" * 10, 1, "q"), (3, None, 1, "q"), (4, "", 1, "q"), (5, "z" * 11, 2, "q"), (6, "w" * 99, 7, "q")], "chunk_id long, content string, options_id long, size string")
    options = spark.createDataFrame([(1, 10, 20, 2), (2, 11, 0, None)], "options_id long, chunk_size int, overlap_percentage int, max_chunks int")
    p = splitting.split(chunks, options).orderBy("piece_no").collect()
    assert {r["chunk_id"] for r in p} == {1} and [r["beyond_max"] for r in p] == [False, False, True, True]
    assert [r[0] for r in splitting.found(chunks, options).collect()] == [1]
    assert splitting.split(chunks.limit(0), options).count() == 0


# --- problem 3 ------------------------------------------------------------------------
def shared_brute(rows):
    own, hit = {}, set()
    for i, *texts in rows:
        for t in texts:
            for k in range(len(t or "") - shared_spans.MIN_LEN + 1):
                o = own.setdefault(t[k : k + shared_spans.MIN_LEN], i)
                if o != i:
                    hit |= {o, i}
    return hit


def test_shared_spans_against_brute_force(spark):
    r = random.Random(5)
    rows = [[i, prose(r, 120), prose(r, 40) if i % 3 else None] for i in range(40)]
    for n, length in enumerate((239, 240, 241, 300, 500)):  # spans of just about the length, at odd places
        a, b = rows[2 * n], rows[2 * n + 20]
        span = a[1][37 : 37 + length]
        b[1] = b[1][:51] + "#" + span + "#" + b[1][51:]
    rows[12][1] = "x" * 700  # without any boundary
    rows[13][1] = "y" + "x" * 300
    rows[14][1] = "".join(r.choice("abcdefgh") for _ in range(900))
    rows[15][1] = "q" + rows[14][1][333:600] + "q"
    rows.append([0, rows[0][1], None])  # delivered twice is not another record
    rows += [[100, None, None], [101, "", ""]]
    df = spark.createDataFrame([(*x, "c") for x in rows], "extraction_id long, a string, b string, digest string")
    got = {x[0] for x in shared_spans.found(df, "extraction_id", ["a", "b"]).collect()}
    assert got == shared_brute(rows)
    cov = {x["extraction_id"]: x for x in shared_spans.coverage(df, "extraction_id", ["a", "b"]).collect()}
    assert {i for i, x in cov.items() if x["shared_chars"] >= 240} == got
    assert cov[15]["shared_chars"] == 267 and cov[15]["removable_chars"] == 267 and cov[14]["removable_chars"] == 0
    assert shared_spans.found(df.limit(0), "extraction_id", ["a", "b"]).count() == 0
    cut = {(x["extraction_id"], x["field_name"]): x for x in shared_spans.removed(df, "extraction_id", ["a", "b"]).collect()}
    text = {(i, f): t for i, *ts in rows for f, t in zip("ab", ts)}
    lost = Counter()
    for k, x in cut.items():
        back, at = "", 0
        for c in x["removed_spans"]:
            back += x["text"][len(back) - sum(z["end"] - z["begin"] for z in x["removed_spans"] if z["end"] <= c["begin"]) :][: c["begin"] - at] + text[k][c["begin"] : c["end"]]
            at = c["end"]
            lost[k[0]] += c["end"] - c["begin"]
        assert back + text[k][at:] == text[k] and len(x["text"]) == len(text[k]) - sum(c["end"] - c["begin"] for c in x["removed_spans"])
    assert {i: x["removable_chars"] for i, x in cov.items() if x["removable_chars"]} == lost
    assert cut[15, "a"]["text"] == "qq" and (14, "a") not in cut
    assert shared_spans.removed(df.limit(0), "extraction_id", ["a", "b"]).count() == 0


def test_stretch_of_exactly_gap(spark):
    rows = []
    for k in range(8):
        r = random.Random(k)
        word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))  # noqa: B023, E731
        span = " " + word(138) + ". " + word(99)
        rows += [(2 * k, word(60) + "." + span + "x" + word(300)), (2 * k + 1, word(200) + span + "y" + word(60))]
    df = spark.createDataFrame(rows, "id long, t string")
    assert {x[0] for x in shared_spans.found(df, "id", ["t"]).collect()} == shared_brute(rows) == set(range(16))


def test_spans_are_merged_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "_BLOCK", 64)
    r = random.Random(16)
    long = prose(r, 400)
    df = spark.createDataFrame([(1, prose(r, 20) + "#" + long), (2, long + "#" + prose(r, 90))], "id long, t string")
    got = {(x["id"], x["removable"]): (x["begin"], x["end"]) for x in shared_spans.spans(df, "id", ["t"]).collect()}
    assert got[2, False] == got[2, True] == (0, len(long)) and (1, True) not in got


def test_hot_passage(spark):
    r = random.Random(6)
    hot = prose(r, 60)
    df = spark.createDataFrame([(i, (hot if i % 3 == 0 else "") + prose(r, 50)) for i in range(300)], "id long, t string")
    got = {x[0] for x in shared_spans.found(df, "id", ["t"]).collect()}
    assert got == set(range(0, 300, 3))


# --- problem 4 ---------------------------------------------------------------------------
def test_lookalikes(spark):
    base = "die Wege waren über den Fluß gelegt"
    rows = [
        (1, base), (2, base.replace(" ", " ", 1)), (3, base.replace("e", "е", 1)), (4, base.replace("ü", "ü")), (5, base.replace("Wege", "Ｗｅｇｅ")), (6, base.replace("Fl", "F​l")), (7, base.upper()),
        (8, base.replace("ü", "u")), (9, "­" + base + " "), (10, None), (11, ""), (1, base), (12, "дворец λόγιον"), (13, "дворец λόγιον "), (14, "die Ѕо Wege"), (15, "die So Wege"), (16, "ﬁnden"), (17, "finden"), (18, "x\ny"), (19, "x y"), (20, "m²"), (21, "m2"), (22, "So ist es, so und so"), (23, "Teil Ⅳ 𝐀"), (24, "Teil IV A"),
    ]
    df = spark.createDataFrame([(i, t, None, "c") for i, t in rows], "extraction_id long, extracted_text string, ocr_text string, raw string")
    same = [1, 2, 3, 4, 5, 6, 9]
    want = {(a, b) for a in same for b in same if a < b} | {(12, 13), (14, 15), (16, 17), (23, 24)}
    assert {tuple(x) for x in lookalikes.found(df).collect()} == want
    out = {x["extraction_id"]: x["text"] for x in lookalikes.repaired(df).collect()}
    assert all(out[i] == base for i in same) and out[12] == "дворец λόγιον" and 10 not in out
    assert lookalikes.found(df.limit(0)).count() == 0


def test_vocabulary_refuses(spark):
    rows = [
        (1, "nur еinmal hier"), (2, "nur einmal hier"), (3, "аbсz"),  # a word that stands nowhere else stays as it is
        (4, "the сор of the day"), (5, "a сор is a word"),  # and vouches for no repair of itself, however often it stands
        (6, "сахaр и вода в доме"), (7, "сахар и соль"), (8, "the сахaр was sweet"), (9, "пoлe"),  # the dominant script of a token decides
        (10, "they say со in English"), (11, "co co co"), (12, "some со избы in English"),  # not beside a word of its own script
    ]
    df = spark.createDataFrame([(i, t, None) for i, t in [*rows, rows[0], rows[0]]], "extraction_id long, extracted_text string, ocr_text string")
    out = {x["extraction_id"]: x["text"] for x in lookalikes.repaired(df).collect()}
    assert out == dict(rows) | {1: rows[1][1], 6: "сахар и вода в доме", 8: "the сахар was sweet", 10: "they say co in English"}
    assert lookalikes.repaired(df).count() == len(rows)


def repaired_brute(texts):
    """The final form of every text, one after the other."""
    have = Counter(w for t in texts for w in re.findall(r"[^\W\d_]+", lookalikes.plain(t).lower()))
    out = []
    for t in texts:
        t = lookalikes.plain(t)
        for at, token, _, first, second, whole in lookalikes.repairs(t):
            least = have[token.lower()] if whole else 0
            new = max((x for x in (first, second) if x and have[x.lower()] > least), key=lambda x: have[x.lower()], default=token)
            t = t[:at] + new + t[at + len(token) :]
        out.append(t)
    return out


@pytest.mark.parametrize("rows", [lookalikes.BROADCAST_ROWS, 0])
def test_lookalikes_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(lookalikes, "BROADCAST_ROWS", rows)
    r = random.Random(4)
    words = ["cope", "Rose", "сахар", "поле", "λόγος", "Axe", "hope", "so", "co", "дом", "zoo"]
    swap = str.maketrans({v: k for k, v in zip(lookalikes.CYRILLIC, lookalikes.CYRILLIC_LATIN)})
    texts = []
    for _ in range(120):
        t = [r.choice(words[:2] if r.random() < 0.3 else words) for _ in range(r.randint(1, 4))]
        t = ["".join(c.translate(swap) if r.random() < 0.3 else c for c in w) if r.random() < 0.4 else w for w in t]
        texts.append(r.choice([" ", "\u00a0"]).join(t) + r.choice(["", " ", "\u200b"]))
    final = repaired_brute(texts)
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] * 2, "extraction_id long, extracted_text string, ocr_text string")
    assert {x["extraction_id"]: x["text"] for x in lookalikes.repaired(df).collect()} == dict(enumerate(final))
    want = {(a, b) for a in range(len(texts)) for b in range(a) if texts[a] != texts[b] and final[a] == final[b]}
    assert {(b, a) for a, b in map(tuple, lookalikes.found(df).collect())} == want and len(want) > 20
    links = Counter(x for p in want for x in p)
    got = {x["extraction_id"]: x for x in lookalikes.classes(df).collect()}
    assert {i: x["n_links"] for i, x in got.items()} == links
    assert all(x["class_id"] == min(k for k in range(len(texts)) if final[k] == final[i]) for i, x in got.items())


@given(st.text(alphabet="aäe \n ​­ｅ", max_size=40))
def test_plain_is_idempotent(t):
    once = lookalikes.plain(t)
    assert lookalikes.plain(once) == once
    if lookalikes._is_clean(t):
        assert once == t


# --- problem 5 -------------------------------------------------------------------------------
def test_scan_repair(spark):
    book = "Anna Berg#Die alten Wege#1"
    pages = [
        (1, book, 1, "# I DIE GELBEN TÜRME\n\nEs war ein langer Weg durch die Wäl-\nder, den niemand sonst kannte. Man nahm Natur-\noder Kunstwege, und am Ende war es Zu-\n- 1 -"),
        (2, book, 2, "Die gelben Türme\nfall, daß sie einander fanden.\nSeite 2"),
        (3, book, 3, None),
        (4, book, 4, "Die gelbcn Türme\nEin neuer Absatz mit einem Jahr, nämlich im Jahre\n1852.\nEnde der Geschich-\n4"),
        (5, book, 5, "DIE ALTEN WEGE\nte und mehr.\nCopyright Archiv Berg Buch: 1 Seite: 5"),
        (2, book, 2, "Die gelben Türme\nfall, daß sie einander fanden.\nSeite 2"),
    ]
    schema = "page_id long, book_key string, page_no int, text_with_headers string"
    scan = spark.createDataFrame(pages, schema)
    ocr = spark.createDataFrame([(7, book, 1, 5, "\n".join(t for _, _, _, t in pages[:5] if t))], "scan_id long, book_key string, page_from int, page_to int, structured_text string")
    ext = spark.createDataFrame([(9, book, "die Wälder und der Zufall und die Geschich-\n[12]\nAnna Berg\nte von ihm, so lang wie sonst keine andere\n1852."), (10, None, None), (11, book, "")], "extraction_id long, book_key string, ocr_text string")
    got = {tuple(x) for x in scan_repair.found(ext, ocr, scan).collect()}
    page = {(i, n, k) for f, i, n, k in got if f == "text_with_headers"}
    assert {(i, n) for i, n, k in page if k == "furniture"} == {(1, 6), (2, 1), (2, 3), (4, 1), (4, 5), (5, 1), (5, 3)}
    assert {(i, n) for i, n, k in page if k == "split_word"} == {(1, 3), (1, 5), (4, 4)}
    assert {(n, k) for f, i, n, k in got if f == "ocr_text"} == {(2, "furniture"), (3, "furniture"), (1, "split_word")}
    assert len([1 for f, _, _, k in got if f == "structured_text" and k == "furniture"]) == 7
    assert scan_repair.found(ext.limit(0), ocr.limit(0), scan.limit(0)).count() == 0


def test_scan_repair_joins_paragraphs(spark):
    book = "Anna Berg#Die alten Wege#1"
    more = " ".join(["wirklich schon die Wälder"] * 12) + "."
    pages = [
        (1, book, 1, f"# I DIE GELBEN TÜRME\n\n{more}\n\nEs war fchon ein Weg durch die Wäl-\nder, und vvirklich Natur-\noder Kunstwege, dazu ein Zu-\n- 1 -"),
        (2, book, 2, "Die gelben Türme\nfall, daß sie einander fanden, und\nSeite 2"),
        (3, book, 3, None),
        (4, book, 4, "Die gelbcn Türme\nauch mehr.\n\nEin Ende, ein Zufall.\n4"),
        (2, book, 2, "Die gelben Türme\nfall, daß sie einander fanden, und\nSeite 2"),
    ]
    scan = spark.createDataFrame(pages, "page_id long, book_key string, page_no int, text_with_headers string")
    ocr = spark.createDataFrame([], "scan_id long, book_key string, page_from int, page_to int, structured_text string")
    ext = spark.createDataFrame([(9, book, "Eins\nzwei.\n\ndrei"), (10, None, None)], "extraction_id long, book_key string, ocr_text string")
    got = sorted(map(tuple, scan_repair.repaired(ext, ocr, scan).collect()))
    assert got == [
        ("ocr_text", 9, 1, "Eins zwei."), ("ocr_text", 9, 2, "drei"),
        ("text_with_headers", 1, 1, "# I DIE GELBEN TÜRME"), ("text_with_headers", 1, 2, more),
        ("text_with_headers", 1, 3, "Es war schon ein Weg durch die Wälder, und wirklich Natur- oder Kunstwege, dazu ein Zufall, daß sie einander fanden, und auch mehr."),
        ("text_with_headers", 4, 2, "Ein Ende, ein Zufall."),
    ]
    assert scan_repair.repaired(ext.limit(0), ocr, scan.limit(0)).count() == 0


@pytest.mark.parametrize(
    "lines, want",
    [
        (["im Jahre der Tafeln, also", "1750", "waren es nur noch", "12", "von allen."], set()),  # numbers of the text
        (["eine Zeile", "7", "noch eine", "8", "und eine", "l0", "Ende, dann", "1750"], {1, 3, 5}),  # a sequence, one number misread, a page without
        (["eine Zeile", "220", "eine mehr", "- 12 -", "DIE ALTEN WEGE", "64"], {3, 5}),  # marked, and beside a running line
        (["eine Zeile", " " * 30 + "23", "noch eine"], {1}),
        (["Text im Jahre", "1852.", "und so weiter"], set()),
    ],
)
def test_page_numbers_are_a_sequence(lines, want):
    assert scan_repair._numbers(lines, None, None, None) == want


def test_numbers_of_known_pages():
    assert scan_repair._numbers(["a", "12", "b", "l3", "c", "73", "d", "400"], 12, 13, None) == {1, 3, 5}
    assert scan_repair._numbers(["a", "1234", "b", "7"], 1, 2000, None) == {1, 3} and scan_repair._fits(5, 0, 9) and not scan_repair._fits(55, 1, 9)


def test_words_go_on_beyond_many_pages(spark):
    """Empty pages, pages of furniture only, and windows' ends between the two parts of a word."""
    book = "Anna Berg#Die alten Wege#1"
    head = "\n".join(["Die alten Wege"] * 9)
    pages = [(1, 1, f"Ein Weg, und die Geschich-\n{head}"), *((p, p, r) for p, r in zip(range(2, 20), [None, "", f"{head}\nAnna Berg"] * 6)), (700, 700, f"{head}\nte von ihm, und sonst Zu-"), (1300, 1300, "# II NEUE WEGE\n\nfall und mehr, auch Geschichte."), (1301, 1301, "Zufall.")]
    scan = spark.createDataFrame([(i, book, p, t) for i, p, t in [*pages, pages[0]]], "page_id long, book_key string, page_no int, text_with_headers string")
    none = spark.createDataFrame([], "scan_id long, book_key string, page_from int, page_to int, structured_text string"), spark.createDataFrame([], "extraction_id long, book_key string, ocr_text string")
    got = {(i, n) for _, i, n, k in map(tuple, scan_repair.found(none[1], none[0], scan).collect()) if k == "split_word"}
    assert got == {(1, 1)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_scan_repair_against_proofread_pages(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    book = {x["page_id"]: x["book_key"] for x in read("scan_pages").collect()}
    text = defaultdict(str)
    for x in scan_repair.repaired(read("extractions"), read("ocr_results"), read("scan_pages")).filter("field_name = 'text_with_headers'").collect():
        text[book[x["record_id"]]] += x["text"] + "\n"
    # what the proofreader cut at a page's ends stands inside a paragraph here
    same = [p.strip() in text[book[x["page_id"]]] for x in read("proofread_pages").collect() for p in (x["clean_text"] or "").split("\n\n") if p.strip()]
    assert len(same) > 20 and np.mean(same) >= 0.9


@pytest.mark.parametrize("a, b", [("wirklich", "wirk1ich"), ("Zusammen", "Zusarnmen"), ("waren", "vvaren"), ("schon", "fchon"), ("DIE WEGE", "D I E   W E G E"), ("oder", "odcr")])
def test_fold(a, b):
    assert scan_repair.fold(a) == scan_repair.fold(b)


# --- problem 6 ----------------------------------------------------------------------------------
@pytest.mark.parametrize("rows", [leakage.BROADCAST_ROWS, 0])
def test_leakage_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", rows)
    r = random.Random(7)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([12, 13, 14, 60])))) for i in range(30)] + [(90, None), (91, "")]
    items.append((92, items[3][1]))
    docs = [(i, prose(r, 40)) for i in range(60)]
    for k in range(0, 60, 2):
        w = (items[k % 30][1] or "").split()
        n = r.choice([12, 13, 20])
        docs[k] = (k, prose(r, 10) + " - " + " — ".join(x.upper() for x in w[:n]) + ", " + prose(r, 5))
    docs += [(100, None), (101, ""), docs[0]]
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    own = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(len(w) - 12):
            own[tuple(w[k : k + 13])].add(i)
    want = {(i, j) for i, t in docs for w in [split(t)] for k in range(len(w) - 12) for j in own.get(tuple(w[k : k + 13]), ())}
    D = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, gram int")
    I = spark.createDataFrame(items, "item_id long, text string")  # noqa: E741
    assert {tuple(x) for x in leakage.found(D, I).collect()} == want and want
    rep = {x["item_id"]: x for x in leakage.report(D, I).collect()}
    assert len(rep) == 33 and rep[90]["n_documents"] == 0 and all(rep[j]["n_documents"] == len({a for a, b in want if b == j}) for j in rep)
    assert leakage.found(D.limit(0), I).count() == 0 and leakage.found(D, I.limit(0)).count() == 0


def test_leakage_of_repeated_items(spark):
    r = random.Random(17)
    a, b = ([r.choice(WORDS) + str(i) for i in range(30)] for _ in "ab")
    items = [(1, " ".join(a)), (1, " ".join(a)), (2, " ".join(a)), (2, " ".join(b)), (3, " ".join(b[:20])), (3, None)]
    docs = [(10, " ".join(a[5:20])), (11, "x " + " ".join(b[:13])), (12, " ".join(a[:12]))]
    D = spark.createDataFrame(docs, "doc_id long, text string")
    I = spark.createDataFrame(items, "item_id long, text string")  # noqa: E741
    assert sorted(map(tuple, leakage.found(D, I).collect())) == [(10, 1), (10, 2), (11, 2), (11, 3)]
    assert len(leakage.matches(D, I).filter("item_id = 1").collect()) == 3
    rep = {x["item_id"]: tuple(x)[1:] for x in leakage.report(D, I).collect()}
    assert rep == {1: (30, 1, 3, 0.5), 2: (60, 2, 4, round(28 / 60, 6)), 3: (20, 1, 1, 0.65)}


# --- problem 7 --------------------------------------------------------------------------------------
def test_mixing(spark):
    r = random.Random(8)
    docs = [(i, r.choice(["big", "BIG ", "Big"]) if i % 3 == 0 else "small" if i % 10 == 1 else "mid" if i % 2 else None, prose(r, r.randint(1, 60))) for i in range(1500)] + [(9000, "mid", None), (9001, "mid", ""), (9002, "alien", "x")]
    D = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, source string, text string, n_tokens int")
    T = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.4, 2), ("small", 0.2, 4), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    m = mixing.mix(D, T).collect()
    assert len({x["doc_id"] for x in m}) == len(m) and {x["source"] for x in m} == {"big", "mid", "small"}
    s = {x["source"]: x for x in mixing.shares(D, T).collect()}
    for k, share in (("big", 0.3), ("mid", 0.4), ("small", 0.2)):
        assert s[k]["reached_share"] == pytest.approx(share / 0.9, abs=0.02)
    copies = {k: Counter(x["copies"] for x in m if x["source"] == k) for k in ("big", "mid", "small")}
    assert all(max(c) - min(c) <= 1 for c in copies.values()) and max(copies["small"]) <= 4
    assert s["none"]["mixed_tokens"] == 0
    capped = {x["source"]: x for x in mixing.shares(D, T, total=1e9).collect()}
    assert [capped[k]["most_copies"] for k in ("big", "mid", "small")] == [1, 2, 4]
    assert mixing.mix(D.limit(0), T).count() == 0


@pytest.mark.parametrize("size", [3, 7, 2000])
def test_sampling_equals_prefix_sums(spark, monkeypatch, size):
    monkeypatch.setattr(mixing, "SLICE", size)
    t = spark.createDataFrame([(i, "s", i % 5) for i in range(100)], "doc_id long, source string, n_tokens long")
    p = spark.createDataFrame([("s", 0.3, 100, 1.37)], "source string, target_share double, n_documents long, copies double")
    got = mixing.sample(t, p).collect()
    assert abs(sum(x["copies"] for x in got) - 137) <= 1 and {x["copies"] for x in got} == {1, 2} and len(got) == 100


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
@pytest.mark.parametrize("fill", [1.0, 3.0])
def test_mixture_of_the_test_tables(spark, fill):
    """Shares and caps from the tables' sizes, computed beside."""
    docs, targets = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "mix_targets"))
    size = Counter()
    for x in mixing.with_tokens(docs).select("source", "n_tokens").collect():
        if x["source"] and x["source"].strip():
            size[x["source"].strip().lower()] += x["n_tokens"]
    want = {x["source"].strip().lower(): x for x in targets.collect()}
    total = fill * min(size[k] * x["max_repeats"] / x["target_share"] for k, x in want.items() if size[k] and x["target_share"])
    copies = {k: min(total * x["target_share"] / size[k], x["max_repeats"]) if size[k] else 0 for k, x in want.items()}
    mixed = {k: copies[k] * size[k] for k in want}
    got = {x["source"]: x for x in mixing.shares(docs, targets, fill=fill).collect()}
    assert set(got) == set(want)
    for k, x in got.items():
        assert x["n_tokens"] == size[k] and x["reached_share"] == pytest.approx(mixed[k] / sum(mixed.values()), abs=0.01) and x["most_copies"] <= want[k]["max_repeats"]
        assert x["most_copies"] - copies[k] < 1


def test_text_without_blanks_is_tokenised_whole(spark):
    assert list(mixing._pieces("x" * 250_000)) == ["x" * 250_000]
    assert "".join(mixing._pieces("ab  " * 60_000 + "a b " * 60_000)) == "ab  " * 60_000 + "a b " * 60_000


def test_tokens_of_long_texts(spark):
    t = " ".join(f"word{i}" for i in range(40000))
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string")
    got = {x["doc_id"]: x["n_tokens"] for x in mixing.with_tokens(df).collect()}
    whole = spark.createDataFrame([(1, t[:90000])], "doc_id long, text string")
    assert got[2] == got[3] == 0 and got[1] > mixing.with_tokens(whole).first()["n_tokens"] > 0


# --- problem 8 ------------------------------------------------------------------------------------------
RESIDUE = [
    "Hi {{tagList}},\n\nthank you", "Please send ${a} to ${b}.", "Answer by %NAME% on %TITLE%:", "Hallo #order_no#,", "<%= name %> asked", "@@X@@ / @@Y@@", "I use [[category]] now.", "{summary} | {site.name}", "Best regards, __AUTHOR__", "Hello <SITE_NAME>, I have a problem",
    "Good question.\n\n[Your text here]", "TBD", "TODO: write the answer", "Your content goes here. Your content goes here.", "Blindtext. Blindtext.", "asdf asdf asdf asdf asdf asdf asdf asdf", "Lorem ipsum dolor sit amet, varia ex", "Terpis lorem dolor varia sit ultem ipsum",
    "404 Not Found", "HTTP 403 – Forbidden Sign in to read this answer.", "Error 404: Not Found\nSomething broke on our side", "Fehler 502: Bad Gateway", "503. That's an error.", "Gateway Timeout\n\nmoved", "undefined asked on Invalid Date", "JavaScript is turned off, so this page cannot be shown.",
    "Ohne JavaScript lässt sich die Antwort nicht anzeigen.", "Checking your browser before opening x.example", "Too many requests. Your address has been rate limited, wait.", "Some text\n```\ncode\n\nThe text goes on here. And {{name}} was left.",
]
GOOD = [
    "Replace <YOUR_TOKEN> with your own value in line 38.", "How do I keep \"Text goes here\" out of the form?", "The page shows 502 Bad Gateway only when I load it.", "I get \"Access denied\" here.", "My form needs JavaScript, but some readers have scripts disabled.", "I use lorem ipsum as filler.",
    "```\n<p>Hello {{ name }}</p>\n```\nWhy the braces?", "    echo ${x}\n\nfails", "<pre><code>%X_Y%</code></pre> fails", "> 404 Not Found\n\nis what I read", "Use `{{name}}` in it.", "Which placeholder should I show?", "Not found anything yet, 404 of 549 calls end well.", "", "+1", "Why do I get HTTP 502 (Bad Gateway) whenever it is large?",
]

GENERIC = [
    "Error 418: I'm a teapot", "503 Service Temporarily Unavailable", "This site requires JavaScript.", "Please turn JavaScript on and reload.", "Hello [Name], thank you for your order.", "Insert text here", "Access denied. You need a permission.",
    "JavaScript is required to view this page", "Enable JavaScript to continue", "Diese Seite benötigt JavaScript.", "Fehler 500", "Your browser does not support JavaScript.", "Seite nicht gefunden",
]


def test_residue(spark):
    rows = [(i, t) for i, t in enumerate(RESIDUE)] + [(1000 + i, t) for i, t in enumerate(GOOD)] + [(5000, None), (0, RESIDUE[0])]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, kind string")
    got = {x[0] for x in residue.found(df).collect()}
    assert got == set(range(len(RESIDUE)))
    assert residue.kept(df).count() == len(GOOD) + 1 and residue.kept(df).columns == df.columns
    assert residue.found(df.limit(0)).count() == 0


def test_instruction_templates_need_one_filling(spark):
    rows = [(i, f"Replace <TOKEN_{'ABCDEFGH'[i]}> with the name of {WORDS[i]} now.") for i in range(5)] + [(9, "Replace <YOUR_TOKEN> with your own value.")]
    rows = [(i, t if i == 9 else f"Replace <TOKEN_{'ABCDEFGH'[i]}> with your own value in line 3.") for i, t in rows]
    u = residue.templates(residue.units(residue.scan(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert {(x["n_units"], x["fillings_vary"]) for x in u.collect()} == {(5, True), (1, False)}


@pytest.mark.parametrize("unit", ["Consectetur adipiscing elit, sed eiusmod tempor incididunt", "Magna aliqua labore sit", "Thanks. asdf asdf asdf asdf asdf asdf asdf asdf", "Well, 1. foo, foo; foo foo foo foo foo foo"])
def test_quick_test_lets_all_kinds_pass(monkeypatch, unit):
    texts = [unit, *RESIDUE, *GOOD, *GENERIC, *(f"{s} {x}" for s in residue.STATUS.split("|") for x in ("", "(404)", "Reference 7")), "SEHR GEEHRTER [Name], ja", "HTTP 500", "ENTER YOUR TEXT HERE"]
    quick = [residue._post(t) for t in texts]
    monkeypatch.setattr(residue, "_hints", lambda low: residue.ALL)
    assert quick == [residue._post(t) for t in texts]
    assert any(x[0] for x in residue._post(unit))


@pytest.mark.parametrize("text", GENERIC)
def test_residue_of_other_wording(text):
    assert residue._post(text)[0][0]


def test_page_lines_are_learned(spark):
    moved = "The drawer you asked for was emptied."
    rows = [
        (1, f"404 Not Found\n{moved}\nReference 17"), (2, f"I have a drawer.\n\nBad Gateway\n{moved}\n[881]"), (3, moved), (4, "Unauthorized\n[77]"), (5, "Oops! Bad Gateway\nReference 812"), (6, "A short text.\n\nForbidden\nReference 9"),
        (7, "Come back another day, please.\nReference 11"), (8, "Come back another day, please.\n[5]"), (9, "Same problem here."), (10, "Same problem here."), (11, "The cause was named in [3]."), (12, "The same words follow a message.\n\nNot Found\nMy own question stays here."), (13, "The same words follow a message.\n\nNot Found\nMy own question stays here."), (14, "My own question stays here."), (15, "See below.\n[12]"),
    ]
    got = residue.flagged(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in got} == {1, 2, 3, 4, 5, 6, 7, 8, 12, 13}
    assert {x["doc_id"] for x in got if x["kind"] == "page"} == {1, 2, 3, 7, 8}


def test_slots_are_induced_by_alignment(spark):
    frame = "Dear {}, your order of {} lamps was sent to {} today."
    rows = [(i, frame.format(w.title(), i, "Bergen")) for i, w in enumerate(WORDS[:6])]
    rows += [(20, frame.format("", 7, "Bergen")), (21, frame.format("[your name]", 7, "Bergen")), (22, frame.format("first_name", 7, "Bergen")), (23, "Hello {{first_name}}, welcome."), (24, "I set row_limit to 7 today."), (25, "I set it to 8 , but it fails."), (26, 'It shows "Dear , your order of 3 lamps was sent to Bergen today."'), (27, frame.format("row_limit", 7, "Bergen"))]
    got = {(x["doc_id"], x["kind"]) for x in residue.flagged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(20, "blank"), (21, "default"), (22, "variable"), (23, "variable")}


def test_very_long_text(spark):
    t = ("The text goes on and on, and so it does. " * 60000) + "\n{{name}}"
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    assert residue.found(df).count() == 1


