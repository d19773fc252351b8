"""Operators over the lines of texts: joining, segments, headers, footnotes, dialogue, features.

A text becomes one row per line; lines never leave their document, so windows
are partitioned by document and a document is the largest unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions import patterns as P
from quirespark.functions import text as T
from quirespark.functions.regex import java


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no (from 0), line``; null texts have no line, an empty text has one empty line."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))


def _ends_paragraph(line: Column) -> Column:
    out = F.lit(False)
    for mark in P.PARAGRAPH_ENDS:
        out = out | line.endswith(mark)
    return out


def needs_joining(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n_lines, hits, needs_joining``: whether too few of the first ten lines end like paragraphs.

    Ten lines are the rule's own sample; fewer than seven non-blank lines are always joined.
    """
    x = df.select(F.col(id_col).alias("id"), T.split_filter(F.col(text_col), "\n").alias("x")).filter("x IS NOT NULL")
    head = F.slice("x", 1, 10)
    hits = F.size(F.filter(head, _ends_paragraph))
    k = F.size(head)
    return x.select("id", F.size("x").cast("long").alias("n_lines"), hits.cast("long").alias("hits"), ((F.size("x") < P.MIN_PARAGRAPHS) | (hits < F.ceil(k * 0.7))).alias("needs_joining"))


def join_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, paragraph_no, text, joined, hyphens``: paragraphs of lines joined to flowing text.

    A line goes on in the next one unless that is blank or the line ends like
    a paragraph (a plain full stop is no such end); a hyphen at a joined line
    end is dropped with the line end.
    """
    w = Window.partitionBy("id").orderBy("line_no")
    x = lines(df, id_col, text_col).withColumn("line", T.trim(F.col("line"))).withColumn("next", F.lead("line").over(w))
    x = x.withColumn("joins", (F.col("line") != "") & F.col("next").isNotNull() & (F.col("next") != "") & ~_ends_paragraph(F.col("line")))
    x = x.withColumn("p", F.coalesce(F.sum((~F.col("joins")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("line != ''")
    hyphen = F.col("joins") & F.col("line").endswith("-")
    part = F.when(hyphen, F.expr("substring(line, 1, char_length(line) - 1)")).when(F.col("joins"), F.concat("line", F.lit(" "))).otherwise(F.col("line"))
    g = x.groupBy("id", "p").agg(F.array_sort(F.collect_list(F.struct("line_no", part.alias("part")))).alias("parts"), F.sum(F.col("joins").cast("long")).alias("joined"), F.sum(hyphen.cast("long")).alias("hyphens"))
    return g.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("p")) - 1).cast("long").alias("paragraph_no"), F.array_join("parts.part", "").alias("text"), "joined", "hyphens")


def segments(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, first_line, n_lines, text``: runs of non-blank lines, joined by blanks."""
    w = Window.partitionBy("id").orderBy("line_no")
    x = lines(df, id_col, text_col).withColumn("blank", T.trim(F.col("line")) == "").withColumn("p", F.sum(F.col("blank").cast("int")).over(w)).filter("NOT blank")
    g = x.groupBy("id", "p").agg(F.array_sort(F.collect_list(F.struct("line_no", T.trim(F.col("line")).alias("line")))).alias("x"))
    return g.select("id", F.col("x")[0]["line_no"].cast("long").alias("first_line"), F.size("x").cast("long").alias("n_lines"), F.array_join("x.line", " ").alias("text"))


_KEYWORD = java(r"(Kapitel|Teil|Part|Abschnitt|Vortrag|Lecture|Vorlesung|Section|Unterkapitel)", True)


def headers(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, type, pattern_no, line, number, level``: the first matching pattern of each header family.

    A line can be a header of several families. ``number`` is its first
    numeric or roman group; chapters and lectures are of level 1, sections of 2.
    """
    x = lines(df, id_col, text_col).withColumn("line", T.trim(F.col("line"))).filter("line != ''")
    found = []
    for name, family in P.HEADERS:
        hit = F.coalesce(*[F.when(T.matches(F.col("line"), p, i), F.lit(k)) for k, (p, i) in enumerate(family)])
        number: Column | None = None
        for k, (p, i) in enumerate(family):
            import re

            g = re.compile(p).groups
            groups = [F.regexp_extract("line", java(p, i), n) for n in range(1, g + 1)]
            first = F.coalesce(*[F.when(v.rlike(r"^(?:[0-9]+|(?i:[IVXLCDM]+))\z"), v) for v in groups]) if groups else F.lit(None).cast("string")
            number = F.when(hit == k, first) if number is None else number.when(hit == k, first)
        found.append(F.when(hit.isNotNull(), F.struct(F.lit(name).alias("type"), hit.cast("long").alias("pattern_no"), number.alias("number"), F.lit(2 if name == "section" else 1).cast("long").alias("level"))))
    return x.select("id", F.col("line_no").cast("long").alias("line_no"), "line", F.explode(F.array_compact(F.array(*found))).alias("h")).select("id", "line_no", "h.type", "h.pattern_no", "line", "h.number", "h.level")


def header_statistics(h: DataFrame) -> DataFrame:
    """``id, type, pattern_no, n, confidence, examples``: per document and pattern, with the first three lines as examples."""
    g = h.groupBy("id", "type", "pattern_no").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("line_no", "line"))), 1, 3)["line"].alias("examples"))
    return g.select("id", "type", "pattern_no", "n", F.when(F.col("n") > 1, 0.8).otherwise(0.6).alias("confidence"), "examples")


def consistent_numbering(h: DataFrame) -> DataFrame:
    """``id, consistent``: within each header type numbers follow each other without gap; types of one header pass."""
    w = Window.partitionBy("id", "type").orderBy("n")
    n = F.when(F.col("number").rlike(r"^[0-9]+\z"), F.col("number").cast("decimal(38,0)"))
    x = h.withColumn("n", n)
    jumps = x.filter("n IS NOT NULL").withColumn("prev", F.lag("n").over(w)).groupBy("id", "type").agg(F.max((F.col("n") != F.col("prev") + 1) & F.col("prev").isNotNull()).alias("jump"))
    g = x.groupBy("id", "type").agg(F.count("*").alias("k"), F.count("number").alias("numbered")).join(jumps, ["id", "type"], "left")
    bad = (F.col("k") > 1) & ((F.col("numbered") < F.col("k")) | F.coalesce("jump", F.lit(False)))
    return g.groupBy("id").agg((~F.max(bad)).alias("consistent"))


def footnotes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, pattern_no, reference, type``: lines that look like footnotes, by the first matching pattern."""
    x = lines(df, id_col, text_col).withColumn("line", T.trim(F.col("line"))).filter("line != ''")
    hit = F.coalesce(*[F.when(T.matches(F.col("line"), p), F.lit(k)) for k, p in enumerate(P.FOOTNOTES)])
    ref = F.coalesce(*[F.when(hit == k, F.regexp_extract("line", java(p), 1)) for k, p in enumerate(P.FOOTNOTES)])
    ref = F.nullif(ref, F.lit(""))
    kind = F.when(ref.rlike("^[0-9]+$"), "numeric").when(ref.rlike("^[A-Za-z]$"), "alphabetic").when(F.col("line").rlike("[¹²³⁴⁵⁶⁷⁸⁹⁰]"), "superscript").otherwise("symbol")
    return x.select("id", F.col("line_no").cast("long").alias("line_no"), hit.cast("long").alias("pattern_no"), ref.alias("reference"), kind.alias("type")).filter("pattern_no IS NOT NULL")


def paragraph_types(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, type, level``: numbered, bulleted, indented or regular lines, and their depth of indent."""
    x = lines(df, id_col, text_col).filter(T.trim(F.col("line")) != "")
    indent = F.char_length(F.regexp_extract("line", r"^([ \t]*)", 1))
    kind = F.when(T.matches(F.col("line"), P.INDICATORS[0]), "numbered").when(T.matches(F.col("line"), r"^\s*[\*\-•]\s+"), "bulleted").when(indent >= 4, "indented").otherwise("regular")
    return x.select("id", F.col("line_no").cast("long").alias("line_no"), kind.alias("type"), F.floor(indent / 4).cast("long").alias("level"))


def dialogues(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, speaker, speech, note``: lines of ``Speaker: text`` and ``Speaker (note): text``.

    For the plain form the note repeats the speech, as it always did.
    """
    x = lines(df, id_col, text_col).withColumn("line", T.trim(F.col("line")))
    a, b = (java(p) for p in P.DIALOGUES)
    one, two = F.col("line").rlike(a), F.col("line").rlike(b)
    e = lambda p, n: F.regexp_extract("line", p, n)
    return x.filter(one | two).select(
        "id", F.col("line_no").cast("long").alias("line_no"),
        F.when(one, e(a, 1)).otherwise(e(b, 1)).alias("speaker"), F.when(one, e(a, 2)).otherwise(e(b, 3)).alias("speech"), F.when(one, e(a, 2)).otherwise(e(b, 2)).alias("note"),
    )


def dialogue_statistics(d: DataFrame) -> DataFrame:
    """``id, n_lines, n_speakers, speakers``: with the first five different speakers in their order."""
    first = d.groupBy("id", "speaker").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    who = F.slice(F.array_sort(F.collect_list(F.struct("line_no", "speaker"))), 1, 5)["speaker"]
    return first.groupBy("id").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_speakers"), who.alias("speakers"))


def footnote_statistics(f: DataFrame) -> DataFrame:
    """``id, pattern_no, type, n, first_reference``: footnote lines per pattern and kind of reference."""
    return f.groupBy("id", "pattern_no", "type").agg(F.count("*").alias("n"), F.min_by("reference", "line_no").alias("first_reference"))


def features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, feature, n, first_example``: contents, bibliography and index lines."""
    x = lines(df, id_col, text_col)
    hit = F.array_compact(F.array(*[F.when(T.matches(F.col("line"), p, True), F.lit(n)) for n, p in P.FEATURES]))
    return x.select("id", "line_no", "line", F.explode(hit).alias("feature")).groupBy("id", "feature").agg(F.count("*").alias("n"), F.min_by("line", "line_no").alias("first_example"))


def structure_quality(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n_headers, max_level, consistent, n_orphans, score, completeness``: one row per non-null text.

    A footnote without a reference in brackets anywhere in its own text is an
    orphan, counted per footnote line.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("t IS NOT NULL").dropDuplicates(["id"])
    one = docs.select(F.col("id"), F.col("t"))
    h = headers(one, "id", "t")
    hs = h.groupBy("id").agg(F.count("*").alias("nh"), F.max("level").alias("max_level"))
    refs = footnotes(one, "id", "t").filter("reference IS NOT NULL").groupBy("id", "reference").count()
    flat = F.replace(F.col("t"), F.lit("\n"), F.lit(" "))
    orphan = ~F.contains(flat, F.concat(F.lit("["), "reference", F.lit("]"))) & ~F.contains(flat, F.concat(F.lit("("), "reference", F.lit(")")))
    orphans = refs.join(docs, "id").filter(orphan).groupBy("id").agg(F.sum("count").alias("no"))
    j = docs.select("id").join(hs, "id", "left").join(consistent_numbering(h), "id", "left").join(orphans, "id", "left")
    n, ok, o = F.coalesce("nh", F.lit(0)), F.coalesce("consistent", F.lit(True)), F.coalesce("no", F.lit(0))
    score = F.greatest(F.lit(0), 100 - F.when(n == 0, 30).otherwise(0) - F.when(~ok, 15).otherwise(0) - 5 * o)
    return j.select("id", n.cast("long").alias("n_headers"), F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"), ok.alias("consistent"), o.cast("long").alias("n_orphans"), score.cast("long").alias("score"), F.round(F.least(F.lit(1.0), n / 10), 6).alias("completeness"))


def hierarchy(h: DataFrame) -> DataFrame:
    """``id, max_level, n_headers, n_chapters, n_lectures, n_sections, numbering_style`` of documents with headers."""
    style = F.when(F.col("number").rlike(r"^[0-9]+\z"), "numeric").when(F.col("number").rlike(r"(?i)^[IVXLCDM]+\z"), "roman").when(F.col("number").rlike(r"(?i)^[A-Z]\z"), "alphabetic")
    of = lambda k: F.count_if(F.col("type") == k)
    g = h.withColumn("style", style).groupBy("id").agg(F.max("level").alias("max_level"), F.count("*").alias("n_headers"), of("chapter").alias("n_chapters"), of("lecture").alias("n_lectures"), of("section").alias("n_sections"), F.min("style").alias("a"), F.max("style").alias("z"))
    return g.select("id", "max_level", "n_headers", "n_chapters", "n_lectures", "n_sections", F.when(F.col("a").isNull(), "numeric").when(F.col("a") == F.col("z"), F.col("a")).otherwise("mixed").alias("numbering_style"))


def recommendations(quality: DataFrame, n_footnotes: Column, n_dialogues: Column) -> DataFrame:
    """Adds ``recommendations`` to rows of structure_quality(): four rules in fixed order."""
    r = F.array(F.when(F.col("n_headers") == 0, "add_headers"), F.when(n_footnotes > 20, "many_footnotes"), F.when(~F.col("consistent"), "standardize_numbering"), F.when(n_dialogues > 0, "check_dialogues"))
    return quality.withColumn("recommendations", F.array_join(F.array_compact(r), ","))
