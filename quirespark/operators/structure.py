"""Operators over structure entries (headings, contents, numbered paragraphs) of books, and over model answers about them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions import patterns as P
from quirespark.functions import text as T
from quirespark.functions.regex import java


def _any(t: Column, rules: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for p, i in rules:
        out = out | T.matches(t, p, i)
    return out


def entries(df: DataFrame, key: str, array_col: str) -> DataFrame:
    """``book_key, idx, entry``: one row per entry; null arrays have none."""
    return df.select(F.col(key).alias("book_key"), F.posexplode(array_col).alias("idx", "entry"))


def classify(e: DataFrame) -> DataFrame:
    """Adds ``is_toc, is_paragraph, toc_level, paragraph_no`` to entries; null entries are neither."""
    t = T.trim(F.col("entry"))
    word = lambda w: T.matches(t, rf"^{w}\s+\d+", True)
    level = F.when(word("Chapter") | word("Part") | word("Book"), 1).when(word("Section"), 2).otherwise(F.least(F.regexp_count(t, F.lit(r"\.")) + 1, F.lit(5)))
    number = F.coalesce(*[F.when(T.matches(t, p, i), F.try_to_number(F.regexp_extract(t, java(p, i), 1), F.lit("9" * 18))) for p, i in P.PARAGRAPH_NUMBER], F.lit(0))
    return e.withColumns({"is_toc": F.coalesce(_any(t, P.TOC_ENTRY), F.lit(False)), "is_paragraph": F.coalesce(_any(t, P.PARAGRAPH_ENTRY), F.lit(False)), "toc_level": level.cast("long"), "paragraph_no": number.cast("long")})


def warnings(e: DataFrame) -> DataFrame:
    """``book_key, idx, warning``: per-entry rules, duplicates, hierarchy jumps.

    Entry warnings are returned for contents and paragraph entries alike.
    """
    c = classify(e)
    t = T.trim(F.col("entry"))
    n = F.char_length("entry")
    own = F.array_compact(
        F.array(
            F.when(F.col("entry").isNull() | (t == ""), "blank"),
            F.when(F.col("is_toc") & (n > 200), "toc_long"),
            F.when(F.col("is_toc") & (n < 3), "toc_short"),
            F.when(F.col("is_paragraph") & (n > 1000), "paragraph_long"),
            F.when(F.col("is_paragraph") & (n < 10), "paragraph_short"),
        )
    )
    single = c.select("book_key", F.col("idx").cast("long").alias("idx"), F.explode(own).alias("warning"))
    again = e.withColumn("k", F.row_number().over(Window.partitionBy("book_key", T.trim(F.col("entry"))).orderBy("idx"))).filter("k > 1 AND entry IS NOT NULL").select("book_key", F.col("idx").cast("long"), F.lit("duplicate"))
    prev = F.lag("toc_level").over(Window.partitionBy("book_key").orderBy("idx"))
    jump = c.filter("is_toc").withColumn("prev", prev).filter("toc_level > prev + 1").select("book_key", F.col("idx").cast("long"), F.lit("hierarchy_jump"))
    return single.union(again).union(jump)


def suggested_format(entry: Column, paragraph: bool) -> dict[str, Column]:
    """Format errors of a contents or paragraph entry, and a suggestion; the length rule comes last and wins."""
    t = T.trim(entry)
    head, most, lead = (_any(t, [(r"^[§¶P]", False), (r"^Paragraph\s+\d+", True)]), 500, "§1 ") if paragraph else (_any(t, [(r"^\d+\.", False), (r"^Chapter\s+\d+", True)]), 100, "1. ")
    long = F.char_length(entry) > most
    errors = F.array_join(F.array_compact(F.array(F.when(~head, "start"), F.when(long, "length"))), ",")
    return {"errors": F.when(entry.isNotNull(), errors), "suggestion": F.when(long, F.concat(F.substring(entry, 1, most), F.lit("..."))).when(~head, F.concat(F.lit(lead), t)).otherwise(entry)}


def missing_numbers(e: DataFrame) -> DataFrame:
    """``book_key, missing``: paragraph numbers from 1 to the largest that no entry has."""
    p = classify(e).filter("is_paragraph AND paragraph_no > 0").select("book_key", "paragraph_no").distinct()
    top = p.groupBy("book_key").agg(F.max("paragraph_no").alias("top"))
    every = top.select("book_key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top"))).alias("paragraph_no"))
    return every.join(p, ["book_key", "paragraph_no"], "left_anti").withColumnRenamed("paragraph_no", "missing")


def completeness(e: DataFrame) -> DataFrame:
    """``book_key, n_entries, n_toc, n_paragraphs, findings``: warnings and suggestions about a whole structure."""
    g = classify(e).groupBy("book_key").agg(F.count("*").alias("n_entries"), F.count_if("is_toc").alias("n_toc"), F.count_if("is_paragraph").alias("n_paragraphs"))
    f = F.array(
        F.when(F.col("n_toc") == 0, "no_toc"),
        F.when(F.col("n_paragraphs") == 0, "no_paragraphs"),
        F.when((F.col("n_toc") > 0) & (F.col("n_paragraphs") == 0), "add_paragraphs"),
        F.when((F.col("n_paragraphs") > 0) & (F.col("n_toc") == 0), "add_toc"),
        F.when(F.col("n_entries") < 5, "very_few"),
        F.when(F.col("n_entries") > 1000, "very_many"),
    )
    return g.withColumn("findings", F.array_join(F.array_compact(f), ","))


def from_text(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``id, line_no, entry``: structure entries of a structured text before its footnotes: headings whole, other lines by their first five words."""
    body = F.split(F.col(text_col), P.FOOTNOTE_HEADING)[0]
    x = df.select(F.col(key).alias("id"), F.posexplode(F.split(body, "\n")).alias("line_no", "line")).withColumn("line", T.trim(F.col("line"))).filter("line != ''")
    return x.select("id", F.col("line_no").cast("long").alias("line_no"), F.when(F.col("line").startswith("#"), F.col("line")).otherwise(F.array_join(F.slice(T.words(F.col("line")), 1, 5), " ")).alias("entry"))


def footnote_entries(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``id, line_no, entry``: footnote lines without the heading and without a leading mark."""
    x = df.select(F.col(key).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line")).withColumn("line", T.trim(F.col("line")))
    return x.filter((F.col("line") != "") & (F.col("line") != P.FOOTNOTE_HEADING)).select("id", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("line", java(r"^\[[MT]\]\s*"), "").alias("entry"))


def similarity(a: Column, b: Column) -> Column:
    """Common words of two entries over the longer one's words; 1 for entries equal but for case and blanks at the ends."""
    x, y = F.lower(T.trim(a)), F.lower(T.trim(b))
    u, v = T.words(x), T.words(y)
    return F.when(x == y, 1.0).otherwise(F.round(F.coalesce(F.size(F.filter(u, lambda w: F.array_contains(v, w))) / F.nullif(F.greatest(F.size(u), F.size(v)), F.lit(0)), F.lit(0.0)), 6))


RESPONSE = (
    "struct<matchedEntries: array<struct<originalIndex: int, correctedText: string, confidence: double, position: int>>, newEntries: array<struct<text: string, position: string, confidence: double>>, "
    "corrections: array<struct<index: int, original: string, corrected: string, confidence: double>>, confidence: double>"
)


def parse_responses(df: DataFrame, json_col: str) -> DataFrame:
    """Adds ``response`` and ``response_ok``: an answer must hold all three lists and a confidence."""
    r = F.from_json(json_col, RESPONSE)
    ok = r.matchedEntries.isNotNull() & r.newEntries.isNotNull() & r.corrections.isNotNull() & r.confidence.isNotNull()
    return df.withColumn("response", r).withColumn("response_ok", F.coalesce(ok, F.lit(False)))


def _best(parsed: DataFrame, entries: str, index: str) -> DataFrame:
    """``book_key, idx, corrected, confidence, ...``: per index the entry of the highest confidence; the earlier chunk wins a tie."""
    c = parsed.filter("response_ok").select("book_key", "chunk_no", F.posexplode(f"response.{entries}").alias("k", "c"))
    best = F.max_by("c", F.struct(F.coalesce("c.confidence", F.lit(0.0)), -F.col("chunk_no"), -F.col("k")))
    return c.groupBy("book_key", F.col(f"c.{index}").cast("long").alias("idx")).agg(best.alias("b"))


def merge_corrections(parsed: DataFrame) -> DataFrame:
    """``book_key, idx, corrected, confidence``: per entry the correction of the highest confidence; the earlier chunk wins a tie."""
    return _best(parsed, "corrections", "index").select("book_key", "idx", "b.corrected", "b.confidence")


def merge_matches(parsed: DataFrame) -> DataFrame:
    """``book_key, idx, corrected, position, confidence``: per matched entry the match of the highest confidence; the earlier chunk wins a tie."""
    return _best(parsed, "matchedEntries", "originalIndex").select("book_key", "idx", F.col("b.correctedText").alias("corrected"), "b.position", "b.confidence")


def merged_confidence(parsed: DataFrame) -> DataFrame:
    """``book_key, n_chunks, n_new, confidence``: the mean over all chunks, failed ones counting 0; new entries are not deduplicated."""
    conf = F.when(F.col("response_ok"), F.col("response.confidence")).otherwise(0.0)
    return parsed.groupBy("book_key").agg(F.count("*").alias("n_chunks"), F.sum(F.when(F.col("response_ok"), F.size("response.newEntries")).otherwise(0)).cast("long").alias("n_new"), F.round(F.avg(conf), 6).alias("confidence"))


def apply_responses(structures: DataFrame, parsed: DataFrame) -> DataFrame:
    """``book_key, structure``: corrections by index, then new entries one after the other into the changed list.

    A new entry "after index n" goes behind place n of the list as it is by
    then and is dropped where the list is too short; any other goes to the
    end. The order matters, so one book's entries are folded in one row.
    """
    new = parsed.filter("response_ok").select("book_key", "chunk_no", F.posexplode("response.newEntries").alias("k", "n")).groupBy("book_key").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "k", F.col("n.text").alias("text"), F.col("n.position").alias("position")))).alias("new"))
    fix = merge_corrections(parsed).groupBy("book_key").agg(F.collect_list(F.struct("idx", "corrected")).alias("fix"))
    j = structures.select("book_key", "structure").join(fix, "book_key", "left").join(new, "book_key", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for b in batches:
            out = []
            for key, s, fx, nw in zip(b["book_key"], b["structure"], b["fix"], b["new"]):
                s = [] if s is None else list(s)
                for f in [] if fx is None else fx:
                    if 0 <= f["idx"] < len(s):
                        s[f["idx"]] = f["corrected"]
                for n in [] if nw is None else nw:
                    m = re.search(r"after index (\d+)", n["position"] or "")
                    if not m:
                        s.append(n["text"])
                    elif int(m[1]) + 1 <= len(s):
                        s.insert(int(m[1]) + 1, n["text"])
                out.append((key, s))
            yield pd.DataFrame(out, columns=["book_key", "structure"])

    return j.mapInPandas(run, "book_key string, structure array<string>")


def prompt(structure: Column, chunk: Column) -> Column:
    """The request about one chunk: the numbered structure, then the text."""
    numbered = F.array_join(F.transform(structure, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.concat(F.lit("Structure:\n"), numbered, F.lit("\n\nText:\n"), chunk)
