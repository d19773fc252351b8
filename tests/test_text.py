import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirespark.functions import files as N
from quirespark.functions import regex as X
from quirespark.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "f, given_, want",
    [
        (T.remove_garbage, "a | | b", "a | b"),
        (T.remove_garbage, "I EINLEITUNG .", "I EINLEITUNG"),
        (T.remove_garbage, None, None),
        (T.strip_html, "<p>Tom &amp;lt; Jerry&nbsp;&#65;&#x42;</p>", "Tom < Jerry AB"),
        (T.strip_html, "&#8364;", "€"),
        (T.collapse_blanks, "a\n\n b\nc", "a b\nc"),
        (T.normalize, " ä\r\n b ", "ä b"),
        (T.fix_mojibake, "Ã¼ber â€œxâ€", 'über "x"'),
        (T.clean_plain, "a\x01b\r\n\n\n\nc \t d", "ab\n\nc d"),
        (T.replace_debris, "||~~", " "),
        (T.replace_debris, "a......b", "a...b"),
        (T.broken_words, "this is a book", 1),
        (T.debris_count, "ä||", 2),
        (T.readability, "The cat sat. It ran!", 100.0),
        (T.readability, "", 0.0),
        (T.readability, None, None),
        (T.syllables, "The cat sat. It ran!", 5),
        (T.language, "der die das und", "de"),
        (T.language, None, None),
        (lambda t: T.fix_umlauts(t)[0], "fiir Natiirliche Weib", "für natürliche weiß"),
        (lambda t: T.fix_umlauts(t)[1], "fiir Natiirliche Weib", 3),
        (lambda t: T.fix_umlauts(t)[0], "langer als", "länger als"),
        (T.cleanliness, "aaaa", 0.75),
        (T.cleanliness, "", 0.0),
    ],
)
def test_vectors(spark, f, given_, want):
    got = one(spark, given_, f)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_quality_of_short_and_null(spark):
    q = lambda k: (lambda t: T.quality(t, "txt")[k])
    assert one(spark, "short", q("score")) == 75
    assert one(spark, "short", q("issues")) == "missing_text"
    assert one(spark, None, q("score")) is None
    assert one(spark, "a" * 120, lambda t: T.quality(t, "pdf")["issues"]) == "corruption"


@pytest.mark.parametrize("before, after, want", [("B", "E", " x "), (None, "E", "a B x "), ("B", None, " x E z"), ("E", "B", " z"), ("no", "no", "a B x E z")])
def test_boundaries(spark, before, after, want):
    df = spark.createDataFrame([("a B x E z", before, after)], "t string, b string, e string")
    assert df.select(T.boundaries(F.col("t"), F.col("b"), F.col("e"))["text"].alias("r")).first()["r"] == want


@pytest.mark.parametrize("ms, want", [(5, "5ms"), (1500, "1s"), (61000, "1m 1s"), (3661000, "1h 1m 1s")])
def test_duration(spark, ms, want):
    assert one(spark, ms, T.duration, "long") == want


def test_template_keeps_unknown(spark):
    assert one(spark, "{a} {b}", lambda t: T.fill_template(t, {"a": F.lit("x"), "b": F.lit(None).cast("string")})) == "x {b}"


def test_removal_patterns(spark):
    out = lambda bare: one(spark, "a.b axb [", lambda t: T.remove_patterns(t, ["a.b", "/x/", "["], bare)[0])
    assert out(False) == " ab "
    assert out(True) == "  ["


@given(st.text(alphabet="ab ä\n.!|~", max_size=60))
def test_collapse_is_idempotent(t):
    # the rule itself, in Python: what the column function must be equal to
    once = re.sub(r"\s\s+", " ", t)
    assert re.sub(r"\s\s+", " ", once) == once


def test_regex_dialects():
    assert X.java(r"[\s]x$") .endswith(r"x\z")
    assert r"\b" in X.re2(r"\bx") and "(?<" in X.java(r"\bx")


@pytest.mark.parametrize(
    "name, want",
    [("Jane_Doe#Sample_Book.epub", ("Jane Doe", "Sample Book", None, True)), ("A_B#C#1.pdf", ("A B", "C", "1", True)), ("sample-book.txt", (None, None, None, False)), (None, (None, None, None, False))],
)
def test_filenames(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert tuple(df.select(*[c.alias(k) for k, c in N.parse_filename(F.col("n")).items()]).first()) == want


@pytest.mark.parametrize(
    "data, name, want",
    [(b"%PDF-1", "a.pdf", ("pdf", 0.95)), (b"%PDF-1", "a.txt", ("pdf", 0.76)), (b"PK\x03\x04", "a.epub", ("epub", 0.4)), (b"\xef\xbb\xbfx", "a.txt", ("txt", 0.4)), (b"plain", "a.txt", ("txt", 0.3)), (b"", "a.txt", ("txt", 0.0))],
)
def test_formats(spark, data, name, want):
    df = spark.createDataFrame([(bytearray(data), name, 10, name.endswith(".pdf") or data.startswith(b"%PDF"))], "h binary, n string, s long, v boolean")
    r = N.decide_format(F.col("h"), F.col("n"), F.col("s"), F.col("v"))
    assert tuple(df.select(r["format"].alias("f"), r["confidence"].alias("c")).first()) == want


@pytest.mark.parametrize("data, enc, text", [(b"\xef\xbb\xbfx", "utf8", "x"), ("ä".encode("latin-1"), "latin1", "ä"), ("ä".encode(), "utf8", "ä"), (b"\xff\xfe" + "hä".encode("utf-16-le"), "utf16le", "hä"), (b"", "utf8", "")])
def test_decoding(spark, data, enc, text):
    df = spark.createDataFrame([(bytearray(data),)], "c binary")
    r = N.decode_bytes(F.col("c"))
    assert tuple(df.select(r["encoding"].alias("e"), r["text"].alias("t")).first()) == (enc, text)


def test_names(spark):
    assert one(spark, 'a<b> "c".txt', N.sanitize) == "a_b__c_.txt" or one(spark, 'a<b> "c".txt', N.sanitize).startswith("a_b_")
    df = spark.createDataFrame([("A", "T", None)], "a string, t string, i string")
    assert df.select(N.output_name(F.lit("{author}-{title}[{bookIndex}]"), F.col("a"), F.col("t"), F.col("i"), F.lit("x"), "txt").alias("r")).first()["r"] == "A-T.txt"
    assert df.select(N.book_key(F.col("a"), F.col("t"), F.col("i")).alias("r")).first()["r"] == "A#T"
