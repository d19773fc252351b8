"""Problem 5: noise in text from scanned pages.

Method. Headers and footers are found by fuzzy line repetition at page edges:
lines are folded to a key in which usual misreadings coincide, keys are
counted over the pages of a book, and repeated keys, the book's own names and
its chapter headings make the book's dictionary of running lines, which is
then joined to candidate lines by key, and by key halves with a bounded edit
distance for what is misread worse. Page numbers are recognised by form and
removed where they fit the sequence of their pages. Lines are then joined; a
word cut at a line end is rejoined by corpus-vocabulary rules: the hyphen
belongs to the text where the vocabulary knows the hyphenated form better than
the joined one or where a conjunction follows. The next line may stand below
furniture, on the next page or in the next run.

Everything is decided line by line: texts are read once, only interesting lines
become rows, and books are never gathered into one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirespark.llm.common import durable, small
from quirespark.llm.lookalikes import _TO_LATIN, plain

# --- fixed values --------------------------------------------------------------
HYPHENS = "-‐¬‑⸗"
CONJUNCTIONS = "und oder bzw bis sowie noch wie als aber and or to nor but as than versus vs".split()
LAST_BEFORE_YEAR = frozenset("in jahre year jahr since by seit anno of".split())
# ----------------------------------------------------------------------------------

_GONE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_SPACES = {ord(c): " " for c in "      \t"}
_CLEAN = _GONE | _SPACES
_FOLD = str.maketrans({"1": "l", "|": "l", "!": "l", "i": "l", "j": "l", "0": "o", "6": "o", "ö": "o", "ä": "a", "5": "t", "s": "t", "f": "t", "ſ": "t", "c": "e", "u": "n", "8": "b", "ß": "b", "ü": "ll"})
_NUMBER = re.compile(r"^\s*((?:[-—–]+|\[|[S5]\.|[S5f][eco][il1][tf][eco]|[pP]\.|[pP]age)\s*)?([0-9lIOoSsBZ|]{1,5})\s*([-—–]+|\]|\.)?\s*$")
_DIGITS = str.maketrans("lIOoSsBZ|", "110055821")
_STAMP = re.compile(r"^\W*c.?opyr.{1,2}ght\b|\bBuc(?:h|li):?\s*\S+\s+[S5]e.?te:?\s*\S+\s*$", re.I)
_ROMAN_HEAD = re.compile(r"^#\s+[IVXLCDMl1|]{1,8}\.?\s+(?=\S{2})(.+)$")
_SECTION = re.compile(r"^##+\s+\d+\.")
_SPACED = re.compile(r"^(?:#+\s*)?(?:[\dlIOSB]+\.?\s+)?(?:\S ){3,}")
_ENDS_NUMBER = re.compile(r"^\s*(?:[\dlIOSB]{1,4}\.?\s+(?=\S{2,} |\S \S ))|\s{2,}[\dlIOSB]*\d[\dlIOSB]*\.?\s*$")
_CUT = re.compile(rf"(\w+)[{HYPHENS}]\s*$")
_FIRST = re.compile(r"^\W*(\w+)")
_BARE = re.compile(r"\s*\S+")
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

_SPAN = 256  # pages of one window; books of any length are spread over several
_STEP = 3  # pages between two printed numbers of one section
BROADCAST_ROWS = 200_000  # corrections that are sent to every task; more are joined


def _plain_line(line: str) -> str:
    """A line in narrow, composed, visible characters and Latin letters; most lines are that already."""
    line = line.translate(_CLEAN)
    if not line.isascii() and any(c > "\u02ff" for c in line):
        line = plain(line).translate(_TO_LATIN) if line.strip() else line
    return line


def fold(text: str) -> str:
    """A key in which the usual misreadings of a line coincide; blanks, case and signs do not count."""
    t = text.lower().translate(_FOLD)
    t = "".join(c for c in t if c.isalpha())
    return t.replace("rn", "m").replace("vv", "w").replace("ll", "h").replace("dl", "eh")


_CONJUNCTIONS = frozenset(map(fold, CONJUNCTIONS))


def _title_like(line: str) -> str | None:
    """The text of a line that could be a running header, without marks and numbers at its ends."""
    t = _ENDS_NUMBER.sub("", line.strip("# "))
    if not t or t[-1] in ".,;:?!»-‐¬" or any(c in t for c in ".,;:?!"):
        return None
    if not (t[0].isupper() or t[0].isdigit() or line.startswith("#")):
        return None
    return t if sum(c.isalpha() for c in t) >= 4 else None


def _close(a: str, b: str) -> bool:
    """Edit distance of at most an eighth of the length, at least one."""
    most = max(1, len(b) // 8)
    if abs(len(a) - len(b)) > most or (a[:4] != b[:4] and a[-4:] != b[-4:]):
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


def _fits(n: int, lo: int, hi: int) -> bool:
    """A printed number lies in a range, one misread digit allowed."""
    if lo <= n <= hi:
        return True
    s = str(n)
    return any(lo <= int(s[:k] + d + s[k + 1 :]) <= hi for k in range(len(s)) for d in "0123456789" if k or d != "0" or len(s) == 1)


def _numbers(lines: list[str], lo: int | None, hi: int | None, edges: set[int] | None) -> set[int]:
    """Line indexes that are page numbers.

    Where the record's pages are known a number must be one of theirs. Else
    several numbers must follow each other in steps of a few pages; a number
    that stands in no such sequence counts only if it is marked as a page number,
    stands beside a line that is furniture by its form, or is the only one. Years that end a sentence on a line of their own are text.
    """
    seen: list[tuple[int, int, bool, bool]] = []
    for i, line in enumerate(lines):
        if edges is not None and i not in edges:
            continue
        m = _NUMBER.match(line)
        if not m:
            continue
        n = int(m[2].translate(_DIGITS))
        if not (any(c.isdigit() for c in m[2]) or m[1] or lo is not None and lo <= n <= hi):
            continue
        before = next((x for x in reversed(lines[:i]) if x.strip()), "")
        last = re.findall(r"\w+", before)[-1:] or [""]
        year = not m[1] and len(m[2]) == 4 and 1400 <= n <= 2099
        seen.append((i, n, year and (m[3] == "." or last[0].lower() in LAST_BEFORE_YEAR), bool(m[1])))
    if lo is not None:
        return {i for i, n, doubt, _ in seen if _fits(n, lo, hi) and (not doubt or lo == hi == n)}
    values = {n for _, n, doubt, _ in seen if not doubt}
    seen = [x for x in seen if not x[2] or {x[1] - 1, x[1] + 1} & values]
    before = [None, *(n for _, n, _, _ in seen)]
    after = [*(n for _, n, _, _ in seen[1:]), None]
    follows = lambda n, a, z: a is not None and _fits(n, a, a + _STEP) or z is not None and _fits(n, z - _STEP, z)

    def at_edge(i: int) -> bool:
        near = [next((x for x in part if x.strip()), "") for part in (reversed(lines[:i]), lines[i + 1 :])]
        return any(_STAMP.search(x) or _SPACED.match(x) or x.isupper() and len(x.split()) >= 2 for x in near)

    return {i for (i, n, _, marked), a, z in zip(seen, before, after) if marked or len(seen) == 1 or follows(n, a, z) or at_edge(i)}


def _broken_early(lines: list[str], full: list[int], sure: dict[int, str], maybe: dict[int, str]) -> None:
    """Running lines of sections whose page edges are lost.

    Capital or spaced-out lines are running lines by their form. A title-like
    line is one, too, if it is clearly shorter than the record's lines although
    the next word of the text would still have fitted on it: text lines are
    filled, and a line that ends a paragraph ends with a sentence.
    """
    for i in list(maybe):
        t = lines[i].lstrip("# ")
        if _SPACED.match(lines[i]) or t.isupper() and len(t.split()) >= 2:
            sure[i] = "form"
            del maybe[i]
    numbered = {i for i in maybe if _ENDS_NUMBER.search(lines[i].lstrip("# "))}
    text = [i for i in full if i not in sure and i not in numbered]
    lengths = sorted(len(lines[i].rstrip()) for i in text)
    width = lengths[int(0.85 * (len(lengths) - 1))] if lengths else 0  # a few lines may stand out
    for i in [i for i in full if i in maybe]:
        # the next line of the text: what looks like another running line is passed over
        rest = [j for j in text if j > i and (j not in maybe or len(lines[j].rstrip()) > 0.8 * width)]
        after = _BARE.match(lines[rest[0]]) if rest else None
        if after and len(lines[i].rstrip()) <= 0.8 * width and len(lines[i].rstrip()) + 1 + len(after[0].strip()) <= width:
            sure[i] = "form"
            del maybe[i]


def _edge(lines: list[str], full: list[int]) -> list[int]:
    """The lines at one end of a page where furniture can stand: three, or more while all of them may be furniture."""
    k = 0
    while k < len(full) and (_NUMBER.match(lines[full[k]]) or _STAMP.search(lines[full[k]]) or _title_like(lines[full[k]])):
        k += 1
    return full[: max(3, k)]


def scan_lines(field: str, text: str, book: str | None, lo: int | None, hi: int | None) -> list[tuple]:
    """Interesting lines of one record: ``(what, line, key, stem, to_end, next)``; lines count from 1."""
    lines = [_plain_line(x) for x in text.split("\n")]
    full = [i for i, x in enumerate(lines) if x.strip()]
    page = field == "text_with_headers"
    edges = {*_edge(lines, full), *_edge(lines, full[::-1])} if page else None
    names = [fold(x) for x in (book or "").split("#")[:2]]
    names = [n for n in names if len(n) >= 4]
    sure: dict[int, str] = {}
    maybe: dict[int, str] = {}
    out: list[tuple] = []
    for i in _numbers(lines, lo, hi, edges):
        sure[i] = "number"
    for i in full:
        line = lines[i]
        if i in sure:
            continue
        if line.startswith("#") and not _SPACED.match(line):
            m = _ROMAN_HEAD.match(line)
            if m:
                out.append(("own", i + 1, fold(m[1]), "", False, []))
                continue
            if _SECTION.match(line):
                continue
        if ("opyr" in line or "Bu" in line) and _STAMP.search(line):
            sure[i] = "stamp"
            continue
        if edges is not None and i not in edges and not line.startswith("#"):
            continue
        t = _title_like(line)
        if t is None:
            continue
        key = fold(t)
        if len(key) >= 4 and any(key == n or _close(key, n) for n in names):
            sure[i] = "name"
        elif len(key) >= 6:
            maybe[i] = key
    if field == "ocr_text":
        _broken_early(lines, full, sure, maybe)
    for i, what in sure.items():
        out.append((what, i + 1, "", "", False, []))
    beside = {full[k + d] for k, i in enumerate(full) if i in sure for d in (-1, 1) if 0 <= k + d < len(full)}
    for i, key in maybe.items():
        out.append(("edge" if page or i in beside or lines[i].startswith("#") else "head", i + 1, key, "", False, []))

    def following(k: int) -> tuple[list[tuple[int, str]], bool]:
        """Candidates for the next line of the text from position k of the non-empty lines on, and whether they run to the end."""
        got: list[tuple[int, str]] = []
        for i in full[k:]:  # ends at the first line that is surely text
            if i in sure:
                continue
            m = _FIRST.match(lines[i])
            if lines[i].startswith("#") and i not in maybe:
                return got, False  # a heading of the text: no word goes on behind it
            # before a conjunction the hyphen belongs to the text: no word goes on there
            got.append((i + 1, m[1] if m and fold(m[1]) not in _CONJUNCTIONS else ""))
            if i not in maybe:
                return got, False
        return got, True

    for k, i in enumerate(full):
        if i in sure or i in maybe and not page:
            continue
        if lines[i].rstrip()[-1:] in HYPHENS:
            m = _CUT.search(lines[i])
            if m and not m[1][-1].isdigit():
                nxt, to_end = following(k + 1)
                out.append(("cut", i + 1, lines[i].rstrip()[-1], m[1], to_end, nxt))
    if field != "ocr_text" and full:
        nxt, to_end = following(0)
        out.append(("top", 0, "", "", to_end, nxt))
    return out


_SCHEMA = "what string, field string, rid long, book string, lo int, hi int, line int, key string, stem string, to_end boolean, next array<struct<line:int, word:string>>"


def scanned(texts: DataFrame) -> DataFrame:
    """Interesting lines and word counts of all records; ``what`` = 'word' rows hold a word in ``key`` and its count in ``rid``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, words = [], Counter()
            for f, r, bk, lo, hi, t in zip(b["field"], b["rid"], b["book"], b["lo"], b["hi"], b["text"]):
                low, high = (None, None) if pd.isna(lo) else (int(lo), int(lo if pd.isna(hi) else hi))
                words.update(_WORDS.findall(t.lower()))
                for what, line, key, stem, to_end, nxt in scan_lines(f, t, bk, low, high):
                    rows.append((what, f, r, bk, low, high, line, key, stem, to_end, nxt))
            rows.extend(("word", None, n, None, None, None, 0, w, None, False, []) for w, n in words.items())
            out = pd.DataFrame(rows, columns=["what", "field", "rid", "book", "lo", "hi", "line", "key", "stem", "to_end", "next"])
            out["lo"], out["hi"] = out["lo"].astype("Int32"), out["hi"].astype("Int32")
            yield out

    return texts.mapInPandas(run, _SCHEMA)


def all_texts(extractions: DataFrame, ocr_results: DataFrame, scan_pages: DataFrame) -> DataFrame:
    """``field, rid, book, lo, hi, text`` of the three scanned fields; null and empty texts have no lines."""
    none = F.lit(None).cast("int")
    e = extractions.select(F.lit("ocr_text").alias("field"), F.col("extraction_id").alias("rid"), F.col("book_key").alias("book"), none.alias("lo"), none.alias("hi"), F.col("ocr_text").alias("text"))
    o = ocr_results.select(F.lit("structured_text").alias("field"), F.col("scan_id").alias("rid"), F.col("book_key").alias("book"), F.col("page_from").cast("int").alias("lo"), F.col("page_to").cast("int").alias("hi"), F.col("structured_text").alias("text"))
    p = scan_pages.select(F.lit("text_with_headers").alias("field"), F.col("page_id").alias("rid"), F.col("book_key").alias("book"), F.col("page_no").cast("int").alias("lo"), (F.col("page_no") + F.lit(0)).cast("int").alias("hi"), F.col("text_with_headers").alias("text"))
    return e.union(o).union(p).filter("text IS NOT NULL AND text != '' AND rid IS NOT NULL")


def running_lines(s: DataFrame) -> DataFrame:
    """``book, key``: chapter headings, and line keys at the edges of two or more pages of a book."""
    own = s.filter("what = 'own'").select("book", "key")
    edge = s.filter("what = 'edge' AND field = 'text_with_headers'").groupBy("book", "key").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).filter("a < b").select("book", "key")
    return own.union(edge).filter("length(key) >= 6 AND book IS NOT NULL").distinct()


def furniture(s: DataFrame) -> DataFrame:
    """``field, rid, line``: lines that belong to the printed page."""
    sure = s.filter("what IN ('number', 'stamp', 'name', 'form')").select("field", "rid", "line")
    runs = durable(running_lines(s))
    cand = s.filter("what IN ('edge', 'head') AND book IS NOT NULL").select("what", "field", "rid", "line", "book", "key")
    exact = cand.join(runs, ["book", "key"], "left_semi").select("field", "rid", "line")
    # misread worse: one of the two ends of the key is intact; every different key is compared once
    rest = cand.filter("what = 'edge'").join(runs, ["book", "key"], "left_anti")
    ends = lambda c: F.explode(F.array(F.concat(F.lit("<"), F.substring(c, 1, 6)), F.concat(F.lit(">"), F.substring(c, -6, 6))))
    near = (
        rest.select("book", "key").distinct()
        .withColumn("end", ends("key"))
        .join(runs.select("book", F.col("key").alias("known")).withColumn("end", ends("known")), ["book", "end"])
        .filter(F.levenshtein("key", "known") <= F.greatest(F.lit(1), F.floor(F.char_length("known") / 6)))
        .select("book", "key").distinct()
    )
    near = rest.join(durable(near), ["book", "key"], "left_semi").select("field", "rid", "line")
    return sure.union(exact).union(near).distinct()


def _beyond(cuts: DataFrame, tops: DataFrame) -> DataFrame:
    """``field, rid, line, key, stem, word``: for cuts at a record's end, the first word of the next record of the book that has text.

    ``cuts`` has ``field, book, at`` (its last page) besides, ``tops`` has ``field,
    book, at`` (its first page) and ``word``. Windows run over ``_SPAN`` pages of a book;
    what follows the last record of a window comes from the windows' own first words.
    """
    none = F.lit(None).cast("string")
    c = cuts.select("field", "book", "at", F.lit(0).alias("top"), "rid", "line", "key", "stem", none.alias("word")).distinct()
    t = tops.groupBy("field", "book", "at").agg(F.min_by("word", "rid").alias("word")).select("field", "book", "at", F.lit(1).alias("top"), F.lit(0).cast("long").alias("rid"), F.lit(0).alias("line"), none.alias("key"), none.alias("stem"), "word")
    x = t.union(c).withColumn("span", F.floor(F.col("at") / _SPAN))
    # a cut comes behind the top of its own page
    w = Window.partitionBy("field", "book", "span").orderBy("at", F.desc("top")).rowsBetween(1, Window.unboundedFollowing)
    x = x.withColumn("next", F.first("word", ignorenulls=True).over(w)).filter("top = 0")
    heads = t.withColumn("span", F.floor(F.col("at") / _SPAN)).groupBy("field", "book", "span").agg(F.min_by("word", "at").alias("head"))
    later = Window.partitionBy("field", "book").orderBy(F.desc("span"))
    need = x.filter("next IS NULL").select("field", "book", "span").distinct()
    heads = need.withColumn("head", none).union(heads).withColumn("after", F.last("head", ignorenulls=True).over(later.rangeBetween(Window.unboundedPreceding, -1))).filter("head IS NULL").drop("head").distinct()
    return x.join(heads, ["field", "book", "span"], "left").select("field", "rid", "line", "key", "stem", F.coalesce("next", "after").alias("word")).filter("word IS NOT NULL")


def split_words(s: DataFrame, furn: DataFrame) -> DataFrame:
    """``field, rid, line, joined``: lines whose last word was cut there, and the whole word."""
    cuts = s.filter("what = 'cut'").select("field", "rid", "book", "hi", "line", "key", "stem", "to_end", "next")
    cuts = cuts.join(furn, ["field", "rid", "line"], "left_anti")
    plain = F.expr("NOT to_end AND size(next) = 1")
    easy = cuts.filter(plain).select("field", "rid", "line", "key", "stem", F.col("next")[0]["word"].alias("word"))

    hard = cuts.filter(~plain)
    inside = hard.select("field", "rid", "line", "key", "stem", F.posexplode("next").alias("pos", "n")).select("field", "rid", "line", "key", "stem", "pos", F.col("rid").alias("to_rid"), F.col("n.line").alias("to_line"), F.col("n.word").alias("word"))
    gone = furn.select("field", F.col("rid").alias("to_rid"), F.col("line").alias("to_line"))
    stays = inside.join(gone, ["field", "to_rid", "to_line"], "left_anti").groupBy("field", "rid", "line", "key", "stem").agg(F.min_by("word", "pos").alias("word"))
    open_ = hard.filter("to_end AND hi IS NOT NULL AND book IS NOT NULL").select("field", "book", F.col("hi").alias("at"), "rid", "line", "key", "stem").join(stays.select("field", "rid", "line"), ["field", "rid", "line"], "left_anti")
    tops = s.filter("what = 'top' AND book IS NOT NULL AND lo IS NOT NULL").select("field", "book", F.col("lo").alias("at"), "rid", "to_end", F.posexplode_outer("next").alias("pos", "n"))
    tops = tops.select("field", "book", "at", "rid", "to_end", "pos", F.col("n.line").alias("line"), F.col("n.word").alias("word")).join(furn.withColumn("gone", F.lit(True)), ["field", "rid", "line"], "left")
    # a record that is furniture to its end is passed over; one whose text begins with a heading ends the search
    tops = tops.groupBy("field", "book", "at", "rid").agg(F.min_by("word", F.when(F.col("gone").isNull() & F.col("line").isNotNull(), F.col("pos"))).alias("word"), F.first("to_end").alias("to_end"))
    tops = tops.select("field", "book", "at", "rid", F.coalesce("word", F.when(~F.col("to_end"), "")).alias("word")).filter("word IS NOT NULL")
    late = stays.union(_beyond(open_, tops))

    pairs = easy.union(late).filter("word != ''")
    starts_low = F.col("word").rlike(r"^[\p{Ll}0-9]") | (F.col("word").rlike(r"^[BI]\p{Ll}"))
    pairs = pairs.filter(starts_low & ~F.col("word").rlike(r"^[0-9]+$") & (F.char_length("stem") >= 1))
    pairs = pairs.withColumn("joined", F.lower(F.concat("stem", "word"))).withColumn("hyphenated", F.lower(F.concat_ws("-", "stem", "word")))

    wanted = durable(pairs.select("field", "rid", "line", "joined", "hyphenated").distinct())
    words = s.filter("what = 'word'").groupBy("key").agg(F.sum("rid").alias("n"))
    looked = wanted.select("joined").union(wanted.select("hyphenated")).distinct().withColumnRenamed("joined", "key")
    known = words.join(looked, "key", "left_semi")
    known = durable(known)
    j = wanted.join(known.select(F.col("key").alias("joined"), F.col("n").alias("nj")), "joined", "left").join(known.select(F.col("key").alias("hyphenated"), F.col("n").alias("nh")), "hyphenated", "left")
    return j.filter(F.coalesce("nh", F.lit(0)) <= F.coalesce("nj", F.lit(0))).select("field", "rid", "line", "joined")


def found(extractions: DataFrame, ocr_results: DataFrame, scan_pages: DataFrame) -> DataFrame:
    """``field_name, record_id, line_no, kind`` with kind 'furniture' or 'split_word'."""
    s = durable(scanned(all_texts(extractions, ocr_results, scan_pages)))
    furn = durable(furniture(s))
    a = furn.select(F.col("field").alias("field_name"), F.col("rid").alias("record_id"), F.col("line").cast("int").alias("line_no"), F.lit("furniture").alias("kind"))
    b = split_words(s, furn).select("field", "rid", F.col("line").cast("int"), F.lit("split_word"))
    return a.union(b).distinct()


# --- repair ----------------------------------------------------------------------
_SURE = 10  # so many times oftener than a misread form must a word stand in the corpus to replace it
_ENDS = re.compile(r"[.!?:…][\"'“”»«’)\]]*$")
_ANY_WORD = re.compile(r"[^\W_](?:[^\W_]|\|(?=[^\W\d_]))*")
_MIXED = re.compile(r"\w+")


def _readable(line: str) -> str:
    """A line in visible characters; foreign look-alikes only become Latin in words that hold Latin letters."""
    line = line.translate(_CLEAN)
    if line.isascii() or not any(c > "\u02ff" for c in line):
        return line
    return _MIXED.sub(lambda m: m[0].translate(_TO_LATIN) if any("a" <= c.lower() <= "ž" for c in m[0]) else m[0], plain(line))


def _glue(text: str, more: str, split: bool) -> str:
    """Two parts of a paragraph; the hyphen of a split word goes, one of the text stays and only before a conjunction is followed by a blank."""
    if split:
        return text[:-1] + more
    m = _FIRST.match(more)
    if text[-1:] in HYPHENS and text[-2:-1].isalnum() and not (m and fold(m[1]) in _CONJUNCTIONS):
        return text + more
    return f"{text} {more}"


def paragraphs_of(text: str, gone: set[int], split: set[int]) -> tuple[list[str], bool]:
    """The paragraphs of one record and whether its last line ends with a split word; a heading stands alone."""
    out: list[str] = []
    last, new = False, True
    for n, line in enumerate(text.split("\n"), 1):
        line = _readable(line).strip()
        if n in gone:
            continue
        if not line:
            new = True
        elif line.startswith("#"):
            out.append(line)
            last, new = False, True
        else:
            if new and not last:
                out.append(line)
            else:
                out[-1] = _glue(out[-1], line, last)
            last, new = n in split, False
    return out, last


_PARAGRAPHS = "field string, rid long, book string, lo int, paragraphs array<string>, last_split boolean"


def paragraphs(texts: DataFrame, furn: DataFrame, splits: DataFrame) -> DataFrame:
    """``field, rid, no, text``: paragraphs without furniture, named by the record and number where they begin.

    A paragraph goes on in the next record of its book that has text if it ends
    without the end of a sentence, or with a split word, or if that record begins
    with a small letter. Only keys and flags are ordered by book; texts are
    grouped by paragraph, and only those that lie in several records.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, r, bk, lo, t, gone, split in zip(b["field"], b["rid"], b["book"], b["lo"], b["text"], b["gone"], b["split"]):
                got, last = paragraphs_of(t, {*gone} if gone is not None else set(), {*split} if split is not None else set())
                if got:
                    rows.append((f, r, bk, None if pd.isna(lo) else int(lo), got, last))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in _PARAGRAPHS.split(", ")])
            out["lo"] = out["lo"].astype("Int32")
            yield out

    marks = furn.select("field", "rid", F.col("line").alias("g"), F.lit(None).cast("int").alias("c")).union(splits.select("field", "rid", F.lit(None).cast("int"), F.col("line")))
    marks = marks.groupBy("field", "rid").agg(F.collect_set("g").alias("gone"), F.collect_set("c").alias("split"))
    records = durable(texts.dropDuplicates(["field", "rid"]).join(marks, ["field", "rid"], "left").mapInPandas(run, _PARAGRAPHS))

    first, last = F.col("paragraphs")[0], F.element_at("paragraphs", -1)
    ends = F.when(last.startswith("#"), "heading").when(F.col("last_split"), "split").when(last.rlike(_ENDS.pattern), "closed").otherwise("open")
    begins = F.when(first.startswith("#"), "heading").when(first.rlike(r"^\p{Ll}"), "small").otherwise("other")
    keys = records.select("field", "rid", "book", "lo", F.size("paragraphs").alias("n"), begins.alias("begins"), ends.alias("ends"))
    w = Window.partitionBy("field", "book").orderBy("lo", "rid")
    runs = keys.filter("book IS NOT NULL AND lo IS NOT NULL").withColumns({"prior": F.lag("ends").over(w), "next_begins": F.lead("begins").over(w)})
    runs = runs.withColumn("goes_on", F.expr("coalesce(ends != 'heading' AND next_begins != 'heading' AND (ends != 'closed' OR next_begins = 'small'), false)"))
    runs = runs.withColumn("came", F.coalesce(F.lag("goes_on").over(w), F.lit(False)))
    # the record in which the paragraph that stands last here began
    runs = runs.withColumn("own", F.when(~F.col("came") | (F.col("n") > 1), F.struct("rid", "n")))
    runs = runs.withColumn("owner", F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).select("field", "rid", "came", "goes_on", "owner")

    each = records.join(runs, ["field", "rid"], "left").select("field", "rid", "lo", "last_split", "came", "goes_on", "owner", F.size("paragraphs").alias("n"), F.posexplode("paragraphs").alias("pos", "text"))
    each = each.withColumn("no", F.col("pos") + 1).withColumn("from", F.expr("coalesce(came AND no = 1, false)")).withColumn("onto", F.expr("coalesce(goes_on AND no = n, false)"))
    alone = each.filter("NOT `from` AND NOT onto").select("field", "rid", "no", "text")
    parts = each.filter("`from` OR onto").select(
        "field", F.when(F.col("from"), F.col("owner.rid")).otherwise(F.col("rid")).alias("to"), F.when(F.col("from"), F.col("owner.n")).otherwise(F.col("no")).alias("no"), F.struct("lo", "rid", "text", (F.col("onto") & F.col("last_split")).alias("split")).alias("part")
    )
    glue = F.udf(_join_parts, "string")
    joined = parts.groupBy("field", "to", "no").agg(F.array_sort(F.collect_list("part")).alias("parts")).select("field", F.col("to").alias("rid"), "no", glue(F.col("parts.text"), F.col("parts.split")).alias("text"))
    return alone.union(joined)


def _join_parts(texts, splits):
    out, split = texts[0], splits[0]
    for t, s in zip(texts[1:], splits[1:]):
        out, split = _glue(out, t, split), s
    return out


def _form(word: str) -> str:
    """Small letters, but a capital inside a word, which is a misreading, is kept."""
    return word.lower() if word.isupper() or word[1:].islower() or word[1:] == word[1:].lower() else word


def _tokens(text: str) -> list[str]:
    return [w for w in _ANY_WORD.findall(text) if len(w) >= 2 and any(c.isalpha() for c in w)]


def corrections(words: DataFrame) -> DataFrame:
    """``form, right, titled``: misread words and the word of the corpus that they stand for.

    ``words`` has ``form, n, n_titled``. Both words have the same folded key, and
    the right one consists of letters and stands ``_SURE`` times as often.
    """
    key = F.udf(fold, "string")  # on the words of the vocabulary, once each
    v = words.groupBy("form").agg(F.sum("n").alias("n"), F.sum("n_titled").alias("titled")).withColumn("key", key("form")).filter("length(key) >= 2")
    best = v.filter(F.col("form").rlike(r"^[\p{Ll}]+$")).groupBy("key").agg(F.max(F.struct("n", "form", "titled")).alias("b")).filter("b.n >= 3")
    return v.join(best, "key").filter(F.col("form") != F.col("b.form")).filter(F.col("b.n") >= _SURE * F.col("n")).select("form", F.col("b.form").alias("right"), (2 * F.col("b.titled") > F.col("b.n")).alias("titled"))


def _correct(text: str, known: dict[str, tuple[str, bool]]) -> str:
    def one(m: re.Match) -> str:
        got = known.get(_form(m[0]))
        if got is None:
            return m[0]
        right, titled = got
        if m[0].isupper() and sum(c.isalpha() for c in m[0]) > 1:
            return right.upper()
        before = text[: m.start()].rstrip()
        misread = not m[0][0].isalpha() or m[0][0] in "lI" and right[0] == "i"
        return right.capitalize() if (titled or not before or _ENDS.search(before[-3:]) if misread else m[0][0].isupper()) else right

    return _ANY_WORD.sub(one, text)


def corrected(p: DataFrame) -> DataFrame:
    """The paragraphs with misread words replaced by those of the corpus that they stand for."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, titled = Counter(), Counter()
            for t in b["text"]:
                for w in _tokens(t):
                    n[_form(w)] += 1
                    titled[_form(w)] += w[0].isupper()
            yield pd.DataFrame([(w, k, titled[w]) for w, k in n.items()], columns=["form", "n", "n_titled"])

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, r, n, w) for f, r, n, t in zip(b["field"], b["rid"], b["no"], b["text"]) for w in {*map(_form, _tokens(t))}], columns=["field", "rid", "no", "form"])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [t if k is None else _correct(t, {x["form"]: (x["right"], x["titled"]) for x in k}) for t, k in zip(b["text"], b["known"])]
            yield b[["field", "rid", "no", "text"]]

    right = durable(corrections(p.select("text").mapInPandas(count, "form string, n long, n_titled long")))
    if small(right, BROADCAST_ROWS):
        shared = p.sparkSession.sparkContext.broadcast({r["form"]: (r["right"], r["titled"]) for r in right.collect()})

        def apply_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["text"] = [_correct(t, shared.value) for t in b["text"]]
                yield b

        return p.select("field", "rid", "no", "text").mapInPandas(apply_all, "field string, rid long, no int, text string")
    found = p.mapInPandas(forms, "field string, rid long, no int, form string").join(right, "form")
    known = found.groupBy("field", "rid", "no").agg(F.collect_list(F.struct("form", "right", "titled")).alias("known"))
    return p.join(known, ["field", "rid", "no"], "left").mapInPandas(apply, "field string, rid long, no int, text string")


def repaired(extractions: DataFrame, ocr_results: DataFrame, scan_pages: DataFrame) -> DataFrame:
    """``field_name, record_id, paragraph_no, text``: continuous paragraphs of the three fields.

    A paragraph has the id and number of the record where it begins; a record
    that only continues one, or has no text of its own, has no row for it.
    Null and empty texts have no paragraphs; equal rows give one result.
    """
    texts = all_texts(extractions, ocr_results, scan_pages)
    s = durable(scanned(texts))
    furn = durable(furniture(s))
    splits = split_words(s, furn).select("field", "rid", "line").distinct()
    p = durable(paragraphs(texts, furn, splits))
    return corrected(p).select(F.col("field").alias("field_name"), F.col("rid").alias("record_id"), F.col("no").alias("paragraph_no"), "text")
