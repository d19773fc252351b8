"""Operators over recognised pages: line positions, line types, header patterns, the page fold, joining of pages.

One row is a line of a page; what depends on the order of lines runs per
page, which is a bounded unit, and pages are joined by their numbers, never
by gathering a book.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions import patterns as P
from quirespark.functions import text as T
from quirespark.functions.regex import java

OCR_SCHEMA = (
    "doc_id string, page_no int, text string, confidence double, paragraphs array<struct<text: string, confidence: double, bbox: struct<x0: double, y0: double, x1: double, y1: double>, "
    "lines: array<struct<text: string, confidence: double, bbox: struct<x0: double, y0: double, x1: double, y1: double>, words: array<struct<text: string, confidence: double, "
    "bbox: struct<x0: double, y0: double, x1: double, y1: double>, symbols: array<struct<text: string, confidence: double, bbox: struct<x0: double, y0: double, x1: double, y1: double>, "
    "baseline: struct<x0: double, y0: double, x1: double, y1: double, has_baseline: boolean>, is_superscript: boolean, is_subscript: boolean, is_dropcap: boolean>>>>>>>>"
)
TOLERANCE = 7.0
PAGE_CENTRE, CENTRE_TOLERANCE, WIDTH_SHARE = 1240.0, 100.0, 0.99
#: line type -> (offset from the text's left edge, tolerance), in the order in which types claim clusters
OFFSETS = P.BOOK_TYPES["werk"]["offsets"]


def flatten(pages: DataFrame) -> DataFrame:
    """Paragraphs to lines, one running line number per page; paragraphs without lines have none."""
    x = pages.select("doc_id", "page_no", F.flatten(F.transform(F.filter("paragraphs", lambda p: p["lines"].isNotNull()), lambda p: p["lines"])).alias("x"))
    return x.select("doc_id", "page_no", F.posexplode("x").alias("line_no", "l")).select("doc_id", "page_no", "line_no", "l.text", "l.confidence", "l.bbox.x0", "l.bbox.y0", "l.bbox.x1", "l.bbox.y1", "l.words")


def clusters(lines: DataFrame, parity: bool = True) -> DataFrame:
    """``doc_id, page_no, cluster, n, min_x0, max_x0, average_width, max_width``: left edges of a page's lines in first-fit groups.

    Edges are taken in ascending order; each joins the first group whose
    running mean is within TOLERANCE. With ``parity`` widths keep the order of
    the lines while the edges are sorted, as the numbers always were made;
    without it each width stays with its edge. Lines without edges are left
    out. A page's lines are folded in one array expression.
    """
    p = lines.filter("x0 IS NOT NULL AND x1 IS NOT NULL").groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct(F.col("line_no"), F.col("x0").cast("double").alias("x"), (F.col("x1") - F.col("x0")).cast("double").alias("w")))).alias("l"))
    if parity:
        pairs = F.arrays_zip(F.array_sort(F.col("l.x")).alias("x"), F.col("l.w").alias("w"))
    else:
        pairs = F.transform(F.array_sort(F.transform("l", lambda v: F.struct(v["x"].alias("x"), v["line_no"].alias("k"), v["w"].alias("w")))), lambda v: F.struct(v["x"].alias("x"), v["w"].alias("w")))

    group = "struct<n: bigint, sum: double, lo: double, hi: double, wsum: double, wmax: double>"

    def add(groups: Column, v: Column) -> Column:
        near = lambda g: F.abs(v["x"] - g["sum"] / g["n"]) <= TOLERANCE
        first = F.array_position(F.transform(groups, near), F.lit(True))
        grown = lambda g: F.struct(
            (g["n"] + 1).alias("n"), (g["sum"] + v["x"]).alias("sum"), F.least(g["lo"], v["x"]).alias("lo"), F.greatest(g["hi"], v["x"]).alias("hi"), (g["wsum"] + v["w"]).alias("wsum"), F.greatest(g["wmax"], v["w"]).alias("wmax")
        )
        fresh = F.struct(F.lit(1).cast("long").alias("n"), v["x"].alias("sum"), v["x"].alias("lo"), v["x"].alias("hi"), v["w"].alias("wsum"), v["w"].alias("wmax"))
        return F.when(first > 0, F.transform(groups, lambda g, i: F.when(i + 1 == first, grown(g)).otherwise(g))).otherwise(F.array_append(groups, fresh))

    folded = p.select("doc_id", "page_no", F.aggregate(pairs, F.array().cast(f"array<{group}>"), add).alias("g"))
    x = folded.select("doc_id", "page_no", F.posexplode("g").alias("cluster", "g"))
    return x.select("doc_id", "page_no", F.col("cluster").cast("long").alias("cluster"), "g.n", F.col("g.lo").alias("min_x0"), F.col("g.hi").alias("max_x0"), F.round(F.col("g.wsum") / F.col("g.n"), 6).alias("average_width"), F.col("g.wmax").alias("max_width"), F.round(F.col("g.sum") / F.col("g.n"), 6).alias("mean_x0"))


def metrics(lines: DataFrame, parity: bool = True, offsets: dict[str, tuple[float, float]] | None = None, types: DataFrame | None = None, config: dict[str, dict] | None = None) -> DataFrame:
    """``doc_id, page_no, metrics``: the clusters of a page under their line types, in order.

    With ``types`` (``doc_id, book_type``) each book has the offsets of its type
    in ``config``, an unknown or missing type those of 'default'.

    The largest cluster (the first on a tie) is the text; then each type
    claims the nearest unused cluster within its tolerance; what is left is
    unknown-1, unknown-2 and so on.
    """
    of_type, one = config or P.BOOK_TYPES, offsets or OFFSETS
    same = types is None
    c = clusters(lines, parity)
    g = c.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("cluster", "n", "min_x0", "max_x0", "average_width", "max_width", "mean_x0"))).alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, p, cs, kind in zip(b["doc_id"], b["page_no"], b["c"], b["book_type"]):
                cs = list(cs)
                wanted = one if same else of_type.get(kind, of_type.get("default", {})).get("offsets", {})
                main = max(range(len(cs)), key=lambda k: (cs[k]["n"], -k))
                used, rows, base = {main}, [("paragraph-text", cs[main])], cs[main]["mean_x0"]
                for kind, (offset, tolerance) in wanted.items():
                    left = [(abs(v["mean_x0"] - base - offset), k) for k, v in enumerate(cs) if k not in used]
                    best = min(left, default=None)
                    if best and best[0] <= tolerance:
                        used.add(best[1])
                        rows.append((kind, cs[best[1]]))
                rows += [(f"unknown-{n}", cs[k]) for n, k in enumerate((k for k in range(len(cs)) if k not in used), 1)]
                out.append((d, p, [{"type": t, "min_x0": v["min_x0"], "max_x0": v["max_x0"], "average_width": v["average_width"], "max_width": v["max_width"]} for t, v in rows]))
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "metrics"])

    g = g.withColumn("book_type", F.lit(None).cast("string")) if types is None else g.join(types.select("doc_id", "book_type"), "doc_id", "left")
    return g.mapInPandas(run, "doc_id string, page_no int, metrics array<struct<type: string, min_x0: double, max_x0: double, average_width: double, max_width: double>>")


def line_types(lines: DataFrame, m: DataFrame) -> DataFrame:
    """Adds ``line_type``: footnote-start for a line whose words, if there are any, open with a raised mark; else the first metric whose
    range holds the line's left edge, else paragraph-text."""
    hit = F.filter("metrics", lambda v: (v["min_x0"] <= F.col("x0")) & (F.col("x0") <= v["max_x0"]))
    kind = F.coalesce(F.try_element_at(hit, F.lit(1))["type"], F.lit("paragraph-text"))
    if "words" in lines.columns:
        kind = F.when(footnote_mark(F.col("words")) != "", "footnote-start").otherwise(kind)
    return lines.join(m, ["doc_id", "page_no"], "left").withColumn("line_type", kind).drop("metrics")


def book_types(manifests: DataFrame) -> DataFrame:
    """``doc_id, book_type``: the type of each book's newest registration; null where it has none."""
    m = manifests.groupBy(F.col("book_key").alias("doc_id")).agg(F.max_by(F.struct("original.book_type"), F.coalesce("registered_at", F.lit("0001-01-01").cast("timestamp"))).alias("m"))
    return m.select("doc_id", "m.book_type")


def centred(x0: Column, x1: Column) -> Column:
    return F.abs((x0 + x1) / 2 - PAGE_CENTRE) <= CENTRE_TOLERANCE


def line_centred(x0: Column, x1: Column, max_width: Column) -> Column:
    """Centred, and narrower than the text; without a width of the text any centred line is."""
    return centred(x0, x1) & (F.coalesce(max_width, F.lit(0.0)).eqNullSafe(0.0) | (x1 - x0 <= WIDTH_SHARE * max_width))


def footnote_mark(words: Column) -> Column:
    """The raised digits and stars that open a line's first word, '' for none.

    A symbol is raised if it is lower than 0.7 of the word's height and ends
    above the baseline by more than 5; the first that is not ends the mark.
    """
    first = F.try_element_at(words, F.lit(1))
    height = first["bbox"]["y1"] - first["bbox"]["y0"]
    raised = lambda s: F.coalesce((s["bbox"]["y1"] - s["bbox"]["y0"] < 0.7 * height) & (s["bbox"]["y1"] < s["baseline"]["y1"] - 5) & s["text"].rlike(r"^[0-9*]\z"), F.lit(False))
    symbols = first["symbols"]
    head = F.filter(symbols, lambda s, i: F.forall(F.slice(symbols, F.lit(1), i + 1), raised))
    return F.coalesce(F.array_join(F.transform(head, lambda s: s["text"]), ""), F.lit(""))


# --- header patterns -------------------------------------------------------------
def compile_header(pattern: str) -> tuple[str, list[str]]:
    """An anchored regular expression of the header notation, and the names of its captures.

    Signs of regular expressions stand for themselves; of each placeholder the
    first occurrence is replaced; unknown ones stay as they are.
    """
    body = re.sub(r"[.*+?^$\\]", lambda m: "\\" + m[0], pattern)
    names = re.findall(r"\{([a-z-]+)\}", pattern)
    for name, rx in P.PLACEHOLDERS:
        body = body.replace("{" + name + "}", rx, 1)
    body = re.sub(r"\{(?=[a-z-]+\})", r"\\{", body)
    return f"^{body}$", names


def match_header(t: Column, pattern: str) -> tuple[Column, Column]:
    """Whether trimmed text matches, and the captured values by placeholder name (null where it does not match)."""
    rx, names = compile_header(pattern)
    x = T.trim(t)
    groups = re.compile(rx).groups
    hit = x.rlike(java(rx))
    pairs = [v for i, n in enumerate(names[:groups]) for v in (F.lit(n), F.regexp_extract(x, java(rx), i + 1))]
    return hit, F.when(hit, F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))


def ordinal(t: Column) -> Column:
    """The number that opens or is a heading: a roman number of I to C, else digits, else a German ordinal; null for none."""
    roman = F.regexp_extract(t, java(r"\b(" + "|".join(P.ROMAN) + r")\b"), 1)
    digits = F.regexp_extract(t, java(r"(\d+)"), 1)
    german = F.regexp_extract(F.lower(t), "(?<![a-zäöüß])(" + "|".join(sorted(P.ORDINALS, key=len, reverse=True)) + ")(?![a-zäöüß])", 1)
    lookup = lambda table: F.create_map(*[v for k, n in table.items() for v in (F.lit(k), F.lit(n))])
    return F.coalesce(F.try_element_at(lookup(P.ROMAN), roman), F.try_to_number(F.nullif(digits, F.lit("")), F.lit("9" * 18)).cast("int"), F.try_element_at(lookup(P.ORDINALS), german)).cast("long")


def remove_by_type(df: DataFrame, text: str, config: dict[str, dict] | None = None) -> tuple[Column, Column]:
    """The text without what the removal patterns of its ``book_type`` match, and how often they matched; unknown types are 'default'."""
    config = config or P.BOOK_TYPES
    out, n = T.remove_patterns(F.col(text), config.get("default", {}).get("removal", []), bare_is_regex=True)
    for kind, c in config.items():
        if kind != "default" and c.get("removal"):
            a, k = T.remove_patterns(F.col(text), c["removal"], bare_is_regex=True)
            mine = F.col("book_type").eqNullSafe(F.lit(kind))
            out, n = F.when(mine, a).otherwise(out), F.when(mine, k).otherwise(n)
    return out, n


# --- the page fold --------------------------------------------------------------------
HEADER_LEVELS: list[list[tuple[str, bool]]] = P.BOOK_TYPES["werk"]["headers"]


def _garbage(t: str) -> str:
    other = "[^a-zA-ZäöüÄÖÜß]"
    t = re.sub(rf"({other})\s{{6,}}({other})", r"\1 \2", t)
    t = re.sub(rf"({other})\s{{6,}}", r"\1 ", t)
    t = re.sub(rf"\s{{6,}}({other})", r" \1", t)
    t = re.sub(rf"\s({other})\s", " ", re.sub(r"\s{6,}", " ", t))
    t = re.sub(rf"\s({other})\Z", "", re.sub(rf"^({other})\s", "", t))
    return re.sub(r"\s{2,}", " ", t).strip()


def glue(acc: str, line: str) -> str:
    """A line behind what is there: a hyphen before it goes, unless a capital follows; else a blank between."""
    if not acc:
        return line
    if acc.endswith("-") and not re.match("[A-ZÄÖÜ]", line):
        return acc[:-1] + line
    return f"{acc} {line}"


def fold_page(texts: list[str], x0: list[float], x1: list[float], types: list[str], max_width: float, levels: list[list[tuple[str, bool]]] | None = None) -> tuple[str, str]:
    """Text and footnotes of one page's lines.

    A line that matches a header format (levels in order, first match wins)
    opens a heading, unless the next line goes on in lower case; formats of
    several lines take in following centred lines while the whole still
    matches a format of the level. Other lines join paragraphs, open them, or
    join the footnotes, by their type. The first line of a page continues the
    text if it is of the text's own type.
    """
    forms = [[(re.compile(compile_header(p)[0]), multi) for p, multi in level] for level in (HEADER_LEVELS if levels is None else levels)]
    texts = [t.strip() for t in texts]
    mid = lambda k: abs((x0[k] + x1[k]) / 2 - PAGE_CENTRE) <= CENTRE_TOLERANCE and (not max_width or x1[k] - x0[k] <= WIDTH_SHARE * max_width)
    text, foot, i = "", "", 0
    while i < len(texts):
        line, head = texts[i], None
        clean = _garbage(line) if line else ""
        for depth, level in enumerate(forms, 1):
            hit = next((multi for rx, multi in level if clean and rx.match(clean)), None)
            if hit is None:
                continue
            title, k = clean, i + 1
            while hit and k < len(texts) and mid(k) and texts[k].strip() and any(rx.match(f"{title} {_garbage(texts[k])}") for rx, _ in level):
                title, k = f"{title} {_garbage(texts[k])}", k + 1
            if not (k < len(texts) and re.match("[a-zäöüß]", texts[k].strip())):
                head = (depth, title, k)
            break
        if head:
            text += f"\n\n{'#' * head[0]} {head[1]}\n\n"
            i = head[2]
            continue
        if line.strip():
            kind = types[i]
            if i == 0:
                text += line if kind == "paragraph-text" else f"\n\n{line}"
            elif kind == "paragraph-start":
                text += f"\n\n{line}"
            elif kind == "footnote-start":
                m = re.match(r"^(\d+|[*]+)\s*(.+)$", line)
                if m:
                    foot += f"\n\n[^{m[1]}]: {m[2]}"
                else:
                    text = glue(text, line)
            elif kind == "footnote-text":
                foot = glue(foot, line)
            else:
                text = glue(text, line)
        i += 1
    return text, foot


def fold_pages(lines: DataFrame, types: DataFrame | None = None, config: dict[str, dict] | None = None) -> DataFrame:
    """``doc_id, page_no, text, footnotes``: every page folded by the header formats of its book's type.

    ``types`` (``doc_id, book_type``) names the types, without it all books are of the
    type 'werk'; a type that ``config`` does not know has the formats of 'default'.
    A line delivered twice counts once, lines without a box are left out, null texts
    are blank lines.
    """
    known = config or P.BOOK_TYPES
    one = lines.filter("x0 IS NOT NULL AND x1 IS NOT NULL").dropDuplicates(["doc_id", "page_no", "line_no"])
    m = metrics(one, types=types, config=config)
    width = F.try_element_at(F.filter("metrics", lambda v: v["type"] == "paragraph-text"), F.lit(1))["max_width"]
    typed = line_types(one, m).join(m.select("doc_id", "page_no", F.coalesce(width, F.lit(0.0)).alias("mw")), ["doc_id", "page_no"], "left")
    cell = F.struct("line_no", F.coalesce("text", F.lit("")).alias("text"), "x0", "x1", "line_type")
    g = typed.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(cell)).alias("l"), F.max(F.coalesce("mw", F.lit(0.0))).alias("mw"))
    g = g.withColumn("book_type", F.lit("werk")) if types is None else g.join(types.select("doc_id", "book_type"), "doc_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for ls, w, kind in zip(b["l"], b["mw"], b["book_type"]):
                levels = known.get(kind, known.get("default", {})).get("headers", [])
                got.append(fold_page([x["text"] for x in ls], [x["x0"] for x in ls], [x["x1"] for x in ls], [x["line_type"] for x in ls], w, levels))
            yield pd.DataFrame({"doc_id": b["doc_id"], "page_no": b["page_no"], "text": [t for t, _ in got], "footnotes": [f for _, f in got]})

    return g.mapInPandas(run, "doc_id string, page_no int, text string, footnotes string")


# --- pages of a book -----------------------------------------------------------------
BUCKET = 256  # pages of one window; books of any length are spread over several


def _next_page(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """Adds the first non-blank character of the next non-empty page. Empty pages are skipped.

    Windows run over BUCKET pages of a book; what follows the last page of a
    window comes from a window over the windows' own first pages.
    """
    from pyspark.sql import Window

    x = pages.filter(F.col(text).isNotNull() & (F.col(text) != "")).withColumn("b", F.floor(F.col(page) / BUCKET))
    w = Window.partitionBy(key, "b").orderBy(page)
    x = x.withColumn("n", F.lead(F.substring(F.col(text), 1, 1)).over(w))
    heads = x.groupBy(key, "b").agg(F.min_by(F.substring(F.col(text), 1, 1), page).alias("head"))
    heads = heads.withColumn("after", F.lead("head").over(Window.partitionBy(key).orderBy("b"))).drop("head")
    return x.join(heads, [key, "b"]).withColumn("next_char", F.coalesce("n", "after")).drop("b", "n", "after")


def join_pages(pages: DataFrame, key: str = "book_key", page: str = "page_no", text: str = "text_with_headers") -> DataFrame:
    """``key, page, piece``: what each page adds to its book's text; the pieces in page order are the text.

    A page that ends with a hyphen loses it where the next page starts with a
    sign that is its own lower case (small letters, digits, line ends, points);
    otherwise a blank follows the page, none the last one.
    """
    x = _next_page(pages.dropDuplicates([key, page]), key, page, text)
    low = F.col("next_char") == F.lower("next_char")
    body = F.col(text)
    piece = F.when(F.col("next_char").isNull(), body).when(body.endswith("-") & low, F.expr(f"substring({text}, 1, char_length({text}) - 1)")).when(F.col("next_char") == "\n", body).otherwise(F.concat(body, F.lit(" ")))
    return x.select(key, page, piece.alias("piece"))


def inside_markers(pages: DataFrame, manifests: DataFrame, text: str = "text_with_headers") -> DataFrame:
    """``book_key, page_no``: pages behind the page with the book's start marker, up to the one with its end marker.

    Books without a start marker begin at their first page, without an end
    marker they go on to the last; an end counts only behind the start. Both
    page numbers are found by aggregates, so no book is gathered.
    """
    m = manifests.select("book_key", "text_before", "text_after").dropDuplicates(["book_key"])
    norm = lambda c: F.nullif(T.normalize(F.coalesce(c, F.lit(""))), F.lit(""))
    x = pages.select("book_key", "page_no", norm(F.col(text)).alias("t")).filter("page_no IS NOT NULL").join(m.select("book_key", norm(F.col("text_before")).alias("a"), norm(F.col("text_after")).alias("z")), "book_key", "left")
    starts = x.groupBy("book_key").agg(F.min(F.when(F.contains("t", "a"), F.col("page_no"))).alias("start"))
    x = x.join(starts, "book_key")
    ends = x.filter("start IS NULL OR page_no > start").groupBy("book_key").agg(F.min(F.when(F.contains("t", "z"), F.col("page_no"))).alias("stop"))
    return x.join(ends, "book_key", "left").filter("(start IS NULL OR page_no > start) AND (stop IS NULL OR page_no <= stop)").select("book_key", "page_no").distinct()


def page_profile(lines: DataFrame) -> DataFrame:
    """``doc_id, page_no, n_lines, average_confidence, n_restarts``: lines of a page, and those in which a sentence begins behind another."""
    restart = F.coalesce(F.col("text").rlike(java(r"\.\s+[A-ZÄÖÜ]")), F.lit(False))
    return lines.groupBy("doc_id", "page_no").agg(F.count("*").alias("n_lines"), F.round(F.avg("confidence"), 6).alias("average_confidence"), F.count_if(restart).alias("n_restarts"))


