"""Queries of the document operators by name, and the SQL that gives the same rows.

Each query is a function of the session and the folder of the tables; it runs
over whole tables. The identifiers in the comments are those of the operator
inventory.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import files as N
from quirespark.functions import patterns as P
from quirespark.functions import text as T
from quirespark.functions.regex import NOT_WS, WS, re2
from quirespark.operators import chunks as C
from quirespark.operators import enhance as H
from quirespark.operators import layout as Y
from quirespark.operators import lines as L
from quirespark.operators import runs as R
from quirespark.operators import structure as S
from quirespark.sources.files import choose_source

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(d, f"{name}.parquet"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _cases(spark: SparkSession, name: str, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else _q(v) if isinstance(v, str) else repr(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


# --- SQL fragments ------------------------------------------------------------------
_trim = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"
_words = lambda x: f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"
_parts = lambda x, p: f"list_filter(regexp_split_to_array({x}, {_q(re2(p))}), lambda w: {_trim('w')} <> '')"
_hits = lambda x, p, i=False: f"len(regexp_extract_all({x}, {_q(re2(p, i))}))"
_has = lambda x, p, i=False: f"regexp_matches({x}, {_q(re2(p, i))})"
_sub = lambda x, p, by, i=False: f"regexp_replace({x}, {_q(re2(p, i))}, {_q(by)}, 'g')"
_syll = "list_sum(list_transform(regexp_extract_all(lower({x}), '[A-Za-z0-9_]+'), lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouäöüy]+')) - CASE WHEN suffix(w, 'e') AND len(regexp_extract_all(w, '[aeiouäöüy]+')) > 1 THEN 1 ELSE 0 END)))"


def _readability(x: str) -> str:
    s, w = f"len({_parts(x, '[.!?]+')})", f"len({_words(x)})"
    return f"round(CASE WHEN {s} > 0 AND {w} > 0 THEN greatest(0.0, least(100.0, 206.835::DOUBLE - 1.015::DOUBLE * ({w}::DOUBLE / {s}) - 84.6::DOUBLE * (coalesce({_syll.format(x=x)}, 0)::DOUBLE / {w}))) ELSE 0.0 END, 6)::DOUBLE"


# --- counts and scores of texts (D1-D3, D7, D8, D12, H31) ----------------------------------
@query(f"SELECT extraction_id, section_no, len({_words('extracted_text')})::BIGINT AS words, length(extracted_text)::BIGINT AS chars, len(string_split(extracted_text, chr(10)))::BIGINT AS lines FROM extractions")
def word_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("extracted_text")
    return table(spark, d, "extractions").select("extraction_id", "section_no", T.word_count(t).alias("words"), F.char_length(t).cast("long").alias("chars"), T.line_count(t).alias("lines"))


@query(f"SELECT doc_id, len({_parts('text', '[.!?]+')})::BIGINT AS sentences, len({_words('text')})::BIGINT AS words, coalesce({_syll.format(x='text')}, 0)::BIGINT AS syllables, {_readability('text')} AS readability FROM documents")
def readability(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.sentence_count(t).alias("sentences"), T.word_count(t).alias("words"), T.syllables(t).alias("syllables"), T.readability(t).alias("readability"))


@query(f"SELECT lang, count(*) AS n, round(avg(len({_words('text')})), 6) AS avg_words, round(avg({_readability('text')}), 4) AS avg_readability FROM documents GROUP BY lang")
def readability_by_language(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    x = table(spark, d, "documents").select("lang", T.word_count(t).alias("w"), T.readability(t).alias("r"))
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("avg_words"), F.round(F.avg("r"), 4).alias("avg_readability"))


_ISLANDS = """
    WITH e AS (SELECT DISTINCT enhancement_id, enhanced_text AS x FROM enhancements),
    ch AS (SELECT enhancement_id, i, x[i] AS c FROM (SELECT enhancement_id, x, unnest(range(1, length(x) + 1)) AS i FROM e WHERE x IS NOT NULL)),
    g AS (SELECT enhancement_id, c, i - row_number() OVER (PARTITION BY enhancement_id, c ORDER BY i) AS k FROM ch),
    r AS (SELECT enhancement_id, count(*) AS n FROM (SELECT enhancement_id, c, k, count(*) AS m FROM g WHERE c NOT IN (chr(10), chr(13), chr(8232), chr(8233)) GROUP BY ALL) WHERE m >= 4 GROUP BY enhancement_id)
"""
_bad = f"({_hits('x', P.NON_LATIN)} + coalesce(r.n, 0))"
_per = f"CASE WHEN len({_parts('x', '[.!?]+')}) > 0 THEN len({_words('x')})::DOUBLE / len({_parts('x', '[.!?]+')}) ELSE 0.0 END"
_METRICS = f"""
    enhancement_id, length(x)::BIGINT AS text_length, len({_words('x')})::BIGINT AS word_count, len({_parts('x', '[.!?]+')})::BIGINT AS sentence_count, len({_parts('x', r'\n\s*\n')})::BIGINT AS paragraph_count,
    CASE WHEN x IS NOT NULL THEN round(greatest(0.0, least(1.0, 1 - ({_per} - 15) / 50)), 6) END::DOUBLE AS readability_score,
    round(least(1.0, len({_parts('x', r'\n\s*\n')}) / 10), 6)::DOUBLE AS structure_score,
    CASE WHEN length(x) > 0 THEN round(greatest(0.0, least(1.0, 1 - {_bad}::DOUBLE / length(x))), 6) WHEN x IS NOT NULL THEN 0.0 END::DOUBLE AS cleanliness_score
"""


@query(f"{_ISLANDS} SELECT {_METRICS} FROM e LEFT JOIN r USING (enhancement_id)")
def validation_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "enhancements").select("enhancement_id", "enhanced_text").distinct()
    return x.select("enhancement_id", *[c.alias(k) for k, c in T.validation_metrics(F.col("enhanced_text")).items()])


@query(f"""
    WITH e AS (SELECT DISTINCT enhancement_id, enhanced_text AS x FROM enhancements),
    v AS (SELECT DISTINCT validation_id, enhancement_id, validation_metrics.text_length AS l, validation_metrics.word_count AS w, validation_metrics.sentence_count AS s FROM validations)
    SELECT validation_id, v.enhancement_id, (l - length(x))::BIGINT AS length_drift, (w - len({_words('x')}))::BIGINT AS word_drift, (s - len({_parts('x', '[.!?]+')}))::BIGINT AS sentence_drift
    FROM v JOIN e USING (enhancement_id)""")
def validation_drift(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "enhancements").select("enhancement_id", "enhanced_text").distinct()
    m = {k: c for k, c in T.validation_metrics(F.col("enhanced_text")).items()}
    e = e.select("enhancement_id", m["text_length"].alias("l"), m["word_count"].alias("w"), m["sentence_count"].alias("s"))
    v = table(spark, d, "validations").select("validation_id", "enhancement_id", F.col("validation_metrics.text_length").alias("vl"), F.col("validation_metrics.word_count").alias("vw"), F.col("validation_metrics.sentence_count").alias("vs")).distinct()
    return v.join(e, "enhancement_id").select("validation_id", "enhancement_id", (F.col("vl") - F.col("l")).alias("length_drift"), (F.col("vw") - F.col("w")).alias("word_drift"), (F.col("vs") - F.col("s")).alias("sentence_drift"))


@query(f"""
    WITH e AS (SELECT DISTINCT enhancement_id, regexp_split_to_array(lower(enhanced_text), '{WS}+') AS w FROM enhancements WHERE enhanced_text IS NOT NULL),
    f AS (SELECT enhancement_id, word, count(*) AS n FROM (SELECT enhancement_id, unnest(w) AS word FROM e) GROUP BY ALL)
    SELECT e.enhancement_id, count(*) FILTER (f.n > 0.05 * len(e.w) AND length(word) > 3) AS repeated, (count(*) FILTER (f.n > 0.05 * len(e.w) AND length(word) > 3)) > 5 AS flagged
    FROM e JOIN f USING (enhancement_id) GROUP BY e.enhancement_id""")
def word_repetition(spark: SparkSession, d: str) -> DataFrame:
    """Words of more than three letters that are over a twentieth of a text."""
    e = table(spark, d, "enhancements").select("enhancement_id", F.split(F.lower("enhanced_text"), WS + "+").alias("w")).filter("w IS NOT NULL").distinct()
    f = e.select("enhancement_id", F.size("w").alias("total"), F.explode("w").alias("word")).groupBy("enhancement_id", "total", "word").count()
    n = F.count_if((F.col("count") > F.col("total") * 0.05) & (F.char_length("word") > 3))
    return f.groupBy("enhancement_id").agg(n.alias("repeated"), (n > 5).alias("flagged"))


def _hint_sql(hints: list[str]) -> str:
    return " + ".join(f"contains(lower(substring(text, 1, 1000)), {_q(h)})::INT" for h in hints)


@query(f"SELECT doc_id, CASE WHEN {_hint_sql(P.GERMAN_HINTS)} > {_hint_sql(P.ENGLISH_HINTS)} THEN 'de' WHEN {_hint_sql(P.ENGLISH_HINTS)} > {_hint_sql(P.GERMAN_HINTS)} THEN 'en' WHEN text IS NOT NULL THEN 'auto' END AS language FROM documents")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


# --- cleaning (H1-H9, H17, H19, H20) --------------------------------------------------------
@query(f"SELECT extraction_id, {_trim(f'''regexp_replace(nfc_normalize(extracted_text), '{WS}+', ' ', 'g')''')} AS clean FROM extractions")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extractions").select("extraction_id", T.normalize(F.col("extracted_text")).alias("clean"))


def _garbage_sql(x: str) -> str:
    o = "[^a-zA-ZäöüÄÖÜß]"
    for p, by in ((rf"({o})\s{{6,}}({o})", r"\1 \2"), (rf"({o})\s{{6,}}", r"\1 "), (rf"\s{{6,}}({o})", r" \1"), (r"\s{6,}", " "), (rf"\s({o})\s", " "), (rf"^({o})\s", ""), (rf"\s({o})$", ""), (r"\s{2,}", " ")):
        x = _sub(x, p, by)
    return _trim(x)


@query(f"SELECT DISTINCT doc_id, page_no, line_no, {_garbage_sql('text')} AS clean FROM ocr_lines")
def ocr_garbage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_lines").select("doc_id", "page_no", "line_no", T.remove_garbage(F.col("text")).alias("clean")).distinct()


def _umlaut_sql(x: str) -> tuple[str, str]:
    """RE2 has no look-ahead: what must follow is captured and put back."""
    rules = [(p, i, by) if "(?=" not in p else (re.sub(r"\\b\(\?=(.*?)\((.*)\)\)$", r"(\1(?:\2))", p), i, by + "$1") for p, i, by in P.UMLAUT_RULES]
    n = " + ".join(_hits(x, p, i) for p, i, _ in rules)
    for p, i, by in rules:
        x = _sub(x, p, by.replace("$1", r"\1").replace("$2", r"\2"), i)
    return x, n


@query("SELECT extraction_id, {0} AS fixed, ({1})::BIGINT AS corrections FROM extractions".format(*_umlaut_sql("ocr_text")))
def umlaut_fix(spark: SparkSession, d: str) -> DataFrame:
    out, n = T.fix_umlauts(F.col("ocr_text"))
    return table(spark, d, "extractions").select("extraction_id", out.alias("fixed"), n.alias("corrections"))


@query(f"SELECT DISTINCT page_id, regexp_replace(text_with_headers, '{WS}{WS}+', ' ', 'g') AS clean FROM scan_pages")
def collapse_blanks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scan_pages").select("page_id", T.collapse_blanks(F.col("text_with_headers")).alias("clean")).distinct()


def _plain_sql(x: str) -> str:
    x = f"regexp_replace({x}, '\\r\\n|\\r', chr(10), 'g')"
    x = f"regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"
    x = f"replace(nfc_normalize({x}), chr(160), ' ')"
    for bad, good in P.MOJIBAKE:
        x = f"replace({x}, {_q(bad)}, {_q(good)})"
    return _trim(f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"SELECT DISTINCT enhancement_id, {_plain_sql('enhanced_text')} AS clean FROM enhancements")
def clean_plain_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enhancements").select("enhancement_id", T.clean_plain(F.col("enhanced_text")).alias("clean")).distinct()


def _html_sql(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for name, by in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " ")):
        x = f"replace({x}, {_q(name)}, {_q(by)})"
    return _trim(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


@query(f"SELECT doc_id, {_html_sql('text')} AS clean FROM documents")
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.strip_html(F.col("text")).alias("clean"))


def _debris_sql(x: str) -> str:
    for p, by in P.DEBRIS_REPLACEMENTS:
        x = f"regexp_replace({x}, {_q(p)}, {_q(by)}, 'g')"
    return f"CASE WHEN {_trim(x)} = '' THEN ' ' ELSE {_trim(x)} END"


@query(f"SELECT DISTINCT enhancement_id, {_debris_sql('enhanced_text')} AS clean FROM enhancements")
def debris_replace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enhancements").select("enhancement_id", T.replace_debris(F.col("enhanced_text")).alias("clean")).distinct()


_debris = " + ".join(_hits("ocr_text", p.replace(r"\p{P}", r"\pP").replace(r"\p{S}", r"\pS")) for p in P.DEBRIS)
_broken = _hits("ocr_text", P.BROKEN_WORD, True)


@query(f"SELECT DISTINCT extraction_id, ({_debris})::BIGINT AS debris, ({_broken})::BIGINT AS broken_words FROM extractions WHERE ocr_text IS NOT NULL")
def debris_and_broken_words(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ocr_text")
    return table(spark, d, "extractions").filter(t.isNotNull()).select("extraction_id", T.debris_count(t).alias("debris"), T.broken_words(t).alias("broken_words")).distinct()


@query(f"""
    WITH i AS (SELECT DISTINCT extraction_id, ({_debris}) AS a, ({_broken}) AS b FROM extractions WHERE ocr_text IS NOT NULL)
    SELECT extraction_id, round(greatest(0.0, 1 - 0.03 * (a + b)), 6)::DOUBLE AS quality, round(least(1.0, (0.8 + CASE WHEN a + b > 0 THEN (0.8 * a + 0.7 * b) / (a + b) ELSE 1.0 END) / 2), 6)::DOUBLE AS confidence FROM i""")
def overall_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality and confidence from the issues found in a text (D11): each issue is of medium severity and costs 0.3 of 10."""
    i = debris_and_broken_words(spark, d)
    a, b = F.col("debris"), F.col("broken_words")
    return i.select("extraction_id", F.round(F.greatest(F.lit(0.0), 1 - 0.03 * (a + b)), 6).alias("quality"), F.round(F.least(F.lit(1.0), (0.8 + F.when(a + b > 0, (0.8 * a + 0.7 * b) / (a + b)).otherwise(1.0)) / 2), 6).alias("confidence"))


@query(f"""
    WITH i AS (SELECT DISTINCT extraction_id, ({_debris}) AS a, ({_broken}) AS b FROM extractions WHERE ocr_text IS NOT NULL)
    SELECT 'ocr_debris' AS type, sum(a)::BIGINT AS n FROM i UNION ALL SELECT 'broken_word', sum(b)::BIGINT FROM i""")
def issue_histogram(spark: SparkSession, d: str) -> DataFrame:
    i = debris_and_broken_words(spark, d).agg(F.sum("debris").alias("a"), F.sum("broken_words").alias("b"))
    return i.select(F.expr("stack(2, 'ocr_debris', a, 'broken_word', b) AS (type, n)"))


def _score_sql(x: str) -> str:
    rules = [(f"length({_trim(x)}) < 100", "missing_text", 30), (f"contains({x}, chr(65533))", "encoding", 20), (f"contains({x}, 'â€') OR contains({x}, 'Ã')", "encoding", 15), (f"regexp_matches({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')", "corruption", 10), (f"NOT {_has(x, r'[.!?]\s+[A-Z]')} AND length({x}) > 500", "formatting", 10)]
    score = "105 - " + " - ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, _, p in rules)
    conf = "1.05::DOUBLE - " + " - ".join(f"CASE WHEN {c} THEN {p / 100}::DOUBLE ELSE 0 END" for c, _, p in rules)
    issues = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n, _ in rules) + "], lambda y: y IS NOT NULL), ',')"
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(0, least(100, {score})) END::BIGINT AS score, CASE WHEN {x} IS NOT NULL THEN round(greatest(0.0, least(1.0, {conf})), 6) END::DOUBLE AS confidence, CASE WHEN {x} IS NOT NULL THEN {issues} END AS issues"


@query(f"SELECT DISTINCT enhancement_id, {_score_sql('enhanced_text')} FROM enhancements")
def quality_txt(spark: SparkSession, d: str) -> DataFrame:
    q = T.quality(F.col("enhanced_text"), "txt")
    return table(spark, d, "enhancements").select("enhancement_id", *[c.alias(k) for k, c in q.items()]).distinct()


def _points_sql(x: str, rules: list[tuple[str, str, int]]) -> str:
    score = "100 - " + " - ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, _, p in rules)
    conf = "1.0::DOUBLE - " + " - ".join(f"CASE WHEN {c} THEN {p / 100}::DOUBLE ELSE 0 END" for c, _, p in rules)
    issues = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n, _ in rules) + "], lambda y: y IS NOT NULL), ',')"
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(0, least(100, {score})) END::BIGINT AS score, CASE WHEN {x} IS NOT NULL THEN round(greatest(0.0, least(1.0, {conf})), 6) END::DOUBLE AS confidence, CASE WHEN {x} IS NOT NULL THEN {issues} END AS issues"


_MISSING = (f"length({_trim('x')}) < 100", "missing_text", 30)
_BAD_CHARACTER = ("contains(x, chr(65533))", "encoding", 20)
_NO_SENTENCE = (f"NOT {_has('x', r'[.!?]\s+[A-Z]')} AND length(x) > 500", "formatting", 10)


@query(f"""
    WITH e AS (SELECT DISTINCT extraction_id, extracted_text AS x FROM extractions WHERE file_type LIKE 'pdf%'),
    ch AS (SELECT x, i, x[i] AS c FROM (SELECT x, unnest(range(1, length(x) + 1)) AS i FROM (SELECT DISTINCT x FROM e))),
    g AS (SELECT x, c, i - row_number() OVER (PARTITION BY x, c ORDER BY i) AS k FROM ch WHERE c NOT IN (chr(10), chr(13), chr(8232), chr(8233))),
    r AS (SELECT DISTINCT x FROM (SELECT x, c, k FROM g GROUP BY ALL HAVING count(*) >= 6))
    SELECT extraction_id, {_points_sql('x', [_MISSING, _BAD_CHARACTER, ('x IN (SELECT x FROM r)', 'corruption', 15), _NO_SENTENCE])} FROM e""")
def quality_pdf(spark: SparkSession, d: str) -> DataFrame:
    q = T.quality(F.col("extracted_text"), "pdf")
    return table(spark, d, "extractions").filter("file_type LIKE 'pdf%'").select("extraction_id", *[c.alias(k) for k, c in q.items()]).distinct()


@query(f"SELECT doc_id, {_points_sql('x', [_MISSING, _BAD_CHARACTER, ('regexp_matches(x, $$[<>]$$)', 'formatting', 15), ('len(regexp_extract_all(x, $$(?m)^# $$)) = 0', 'missing_text', 15), _NO_SENTENCE])} FROM (SELECT doc_id, text AS x FROM documents)")
def quality_epub(spark: SparkSession, d: str) -> DataFrame:
    q = T.quality(F.col("text"), "epub", chapters=F.regexp_count("text", F.lit("(?m)^# ")))
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in q.items()])


# --- comparisons of texts (C1, C2, H21, H27, D9, D10, A14, A15) ------------------------------
@query(f"""
    WITH x AS (SELECT DISTINCT extraction_id, extracted_text, ocr_text FROM extractions),
    e AS (SELECT extraction_id, unnest({_words("lower(extracted_text)")}) AS word FROM x),
    o AS (SELECT DISTINCT extraction_id, unnest({_words("lower(coalesce(ocr_text, ''))")}) AS word FROM x)
    SELECT extraction_id, word, count(*) AS n FROM e ANTI JOIN o USING (extraction_id, word) WHERE length(word) > 3 GROUP BY ALL""")
def missing_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the text layer that the recognised text lacks, with their number."""
    x = table(spark, d, "extractions").select("extraction_id", "extracted_text", "ocr_text").distinct()
    e = x.select("extraction_id", F.explode(T.words(F.lower("extracted_text"))).alias("word")).filter(F.char_length("word") > 3)
    o = x.select("extraction_id", F.explode(T.words(F.lower("ocr_text"))).alias("word")).distinct()
    return e.join(o, ["extraction_id", "word"], "left_anti").groupBy("extraction_id", "word").agg(F.count("*").alias("n"))


_long = lambda x: f"list_filter({_words(f'lower({x})')}, lambda w: length(w) > 3)"


@query(f"""
    WITH e AS (SELECT DISTINCT enhancement_id, extraction_id, enhanced_text AS x FROM enhancements), o AS (SELECT DISTINCT extraction_id, extracted_text AS t FROM extractions),
    j AS (SELECT enhancement_id, {_long('t')} AS a, {_long('x')} AS b FROM e JOIN o USING (extraction_id) WHERE x IS NOT NULL)
    SELECT enhancement_id, len(list_filter(a, lambda w: NOT list_contains(b, w)))::BIGINT AS lost, len(a)::BIGINT AS words, round(len(list_filter(a, lambda w: NOT list_contains(b, w)))::DOUBLE / nullif(len(a), 0), 6) AS loss FROM j""")
def word_loss(spark: SparkSession, d: str) -> DataFrame:
    """Words of the extraction that its enhancement lost; the words are compared inside the row, where both texts are."""
    e = table(spark, d, "enhancements").select("enhancement_id", "extraction_id", F.col("enhanced_text").alias("x")).distinct().filter("x IS NOT NULL")
    o = table(spark, d, "extractions").select("extraction_id", F.col("extracted_text").alias("t")).distinct()
    long = lambda c: F.filter(T.words(F.lower(c)), lambda w: F.char_length(w) > 3)
    j = e.join(o, "extraction_id").select("enhancement_id", long("t").alias("a"), F.array_distinct(long("x")).alias("b"))
    kept = F.map_from_arrays("b", F.transform("b", lambda w: F.lit(True)))
    lost = F.size(F.filter("a", lambda w: ~F.map_contains_key(F.col("m"), w)))
    j = j.withColumn("m", kept)
    return j.select("enhancement_id", lost.cast("long").alias("lost"), F.size("a").cast("long").alias("words"), F.round(lost / F.nullif(F.size("a"), F.lit(0)), 6).alias("loss"))


def _issues(x, issues_remaining, issues_fixed):
    """Names and penalties of the validation issues of a text by itself (H27)."""
    sentences = T.split_filter(x, "[.!?]+")
    long = F.size(F.filter(sentences, lambda s: F.size(F.split(s, WS + "+")) > 50))
    rules = [("structure_short", F.char_length(x) < 100, 0.1), ("structure_paragraphs", T.paragraph_count(x) == 0, 0.05), ("readability_long", long > 0.2 * F.size(sentences), 0.02)]
    rules += [(f"cleanliness_{k}", T.count(x, p) > 0, 0.05) for k, p in enumerate(P.ARTIFACTS)]
    rules += [("cleanliness_remaining", F.coalesce(issues_remaining > issues_fixed, F.lit(False)), 0.1), ("formatting_spacing", T.count(x, r"\s{3,}") > 5, 0.02)]
    return rules


def _issues_sql() -> list[tuple[str, str, float]]:
    sent = _parts("x", "[.!?]+")
    rules = [("structure_short", "length(x) < 100", 0.1), ("structure_paragraphs", f"len({_parts('x', r'\n\s*\n')}) = 0", 0.05), ("readability_long", f"len(list_filter({sent}, lambda s: len(regexp_split_to_array(s, '{WS}+')) > 50)) > 0.2 * len({sent})", 0.02)]
    rules += [(f"cleanliness_{k}", f"{_hits('x', p)} > 0", 0.05) for k, p in enumerate(P.ARTIFACTS)]
    return rules + [("cleanliness_remaining", "coalesce(issues_remaining > issues_fixed, false)", 0.1), ("formatting_spacing", _hits("x", r"\s{3,}") + " > 5", 0.02)]


_penalty = " + ".join(f"CASE WHEN {c} THEN {p}::DOUBLE ELSE 0 END" for _, c, p in _issues_sql())
_names = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in _issues_sql()) + "], lambda y: y IS NOT NULL), ',')"


@query(f"""
    {_ISLANDS}, m AS (SELECT {_METRICS}, x FROM e LEFT JOIN r USING (enhancement_id)),
    i AS (SELECT DISTINCT enhancement_id, issues_remaining, issues_fixed FROM enhancements)
    SELECT enhancement_id, {_names} AS issues, round(greatest(0.0, least(1.0, 0.3 * readability_score + 0.3 * structure_score + 0.4 * cleanliness_score - ({_penalty}))), 4)::DOUBLE AS overall_score,
           round(greatest(0.0, least(1.0, 0.3 * readability_score + 0.3 * structure_score + 0.4 * cleanliness_score - ({_penalty}))), 4) >= 0.7 AS is_valid
    FROM m JOIN i USING (enhancement_id) WHERE x IS NOT NULL""")
def overall_score(spark: SparkSession, d: str) -> DataFrame:
    """Weighted scores less penalties (D9); valid from 0.7 on, as no rule here is critical (D10)."""
    x = table(spark, d, "enhancements").select("enhancement_id", F.col("enhanced_text").alias("x"), "issues_remaining", "issues_fixed").distinct().filter("x IS NOT NULL")
    m = T.validation_metrics(F.col("x"))
    rules = _issues(F.col("x"), F.col("issues_remaining"), F.col("issues_fixed"))
    penalty = sum((F.when(c, p).otherwise(0.0) for _, c, p in rules), F.lit(0.0))
    score = F.round(T.clamp(0.3 * m["readability_score"] + 0.3 * m["structure_score"] + 0.4 * m["cleanliness_score"] - penalty, 0.0, 1.0), 4)
    return x.select("enhancement_id", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c, _ in rules])), ",").alias("issues"), score.alias("overall_score"), (score >= 0.7).alias("is_valid"))


@query("""
    SELECT DISTINCT extraction_id, coalesce(nullif(ocr_text, ''), nullif(extracted_text, '')) AS source_text, CASE WHEN nullif(ocr_text, '') IS NOT NULL THEN 'ocr' WHEN nullif(extracted_text, '') IS NOT NULL THEN 'file' END AS source_type,
           CASE WHEN nullif(ocr_text, '') IS NOT NULL THEN 1 WHEN nullif(extracted_text, '') IS NOT NULL THEN 2 END AS source_priority FROM extractions""")
def source_choice(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "extractions").withColumn("stored", F.lit(None).cast("string"))
    return choose_source(x, "ocr_text", "extracted_text", "stored").select("extraction_id", "source_text", "source_type", "source_priority").distinct()


# --- boundaries and markers (H5, B13, E8) ----------------------------------------------------
_M = "(SELECT book_key, min(text_before) AS a, min(text_after) AS z FROM manifests GROUP BY book_key)"
_X = f"nfc_normalize(regexp_replace(extracted_text, '{WS}{WS}+', ' ', 'g'))"


@query(f"""
    WITH j AS (SELECT DISTINCT extraction_id, {_X} AS x, nullif(a, '') AS a, nullif(z, '') AS z FROM extractions LEFT JOIN {_M} m USING (book_key)),
    s AS (SELECT *, CASE WHEN a IS NOT NULL THEN strpos(x, a) ELSE 0 END AS fnd FROM j),
    t AS (SELECT *, CASE WHEN fnd > 0 THEN fnd + length(a) ELSE 1 END AS st FROM s),
    u AS (SELECT *, CASE WHEN z IS NOT NULL AND strpos(substring(x, st), z) > 0 THEN strpos(substring(x, st), z) + st - 1 ELSE 0 END AS ea FROM t)
    SELECT extraction_id, CASE WHEN st >= CASE WHEN ea > 0 THEN ea ELSE length(x) + 1 END THEN x ELSE substring(x, st, CASE WHEN ea > 0 THEN ea ELSE length(x) + 1 END - st) END AS body, fnd > 0 AS start_found, ea > 0 AS end_found FROM u""")
def text_boundaries(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifests").groupBy("book_key").agg(F.min("text_before").alias("a"), F.min("text_after").alias("z"))
    j = table(spark, d, "extractions").select("extraction_id", "book_key", "extracted_text").join(m, "book_key", "left")
    b = T.boundaries(F.col("extracted_text"), F.col("a"), F.col("z"))
    return j.select("extraction_id", b["text"].alias("body"), b["start_found"].alias("start_found"), b["end_found"].alias("end_found")).distinct()


_norm = lambda x: f"nullif({_trim(f'''regexp_replace(nfc_normalize(coalesce({x}, '')), '{WS}+', ' ', 'g')''')}, '')"


@query(f"""
    WITH x AS (SELECT DISTINCT book_key, page_no, {_norm('text_with_headers')} AS t FROM scan_pages WHERE page_no IS NOT NULL),
    m AS (SELECT book_key, {_norm('a')} AS a, {_norm('z')} AS z FROM {_M}),
    j AS (SELECT x.*, a, z FROM x LEFT JOIN m USING (book_key)),
    s AS (SELECT *, min(CASE WHEN contains(t, a) THEN page_no END) OVER (PARTITION BY book_key) AS st FROM j),
    e AS (SELECT *, min(CASE WHEN contains(t, z) AND (st IS NULL OR page_no > st) THEN page_no END) OVER (PARTITION BY book_key) AS en FROM s)
    SELECT DISTINCT book_key, page_no FROM e WHERE (st IS NULL OR page_no > st) AND (en IS NULL OR page_no <= en)""")
def boundary_pages(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifests").groupBy("book_key").agg(F.min("text_before").alias("text_before"), F.min("text_after").alias("text_after"))
    return Y.inside_markers(table(spark, d, "scan_pages"), m)


# --- lines and paragraphs (E1-E3, H25, B20-B25, D14-D18) --------------------------------------
_ends = lambda x: "(" + " OR ".join(f"suffix({x}, {_q(m)})" for m in P.PARAGRAPH_ENDS) + ")"
_EL = "(SELECT DISTINCT enhancement_id AS id, enhanced_text AS x FROM enhancements WHERE enhanced_text IS NOT NULL)"
_LINES = f"l AS (SELECT id, {_trim('line')} AS line, line AS raw, no - 1 AS line_no FROM (SELECT id, unnest(string_split(x, chr(10))) AS line, unnest(range(1, len(string_split(x, chr(10))) + 1)) AS no FROM {_EL}))"


def _enhanced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enhancements").select("enhancement_id", "enhanced_text").distinct()


@query(f"SELECT id, len({_parts('x', chr(92) + 'n')})::BIGINT AS n_lines, len(list_filter({_parts('x', chr(92) + 'n')}[1:10], lambda y: {_ends('y')}))::BIGINT AS hits, (len({_parts('x', chr(92) + 'n')}) < 7 OR len(list_filter({_parts('x', chr(92) + 'n')}[1:10], lambda y: {_ends('y')})) < ceil(0.7 * least(10, len({_parts('x', chr(92) + 'n')})))) AS needs_joining FROM {_EL}")
def needs_normalization(spark: SparkSession, d: str) -> DataFrame:
    return L.needs_joining(_enhanced(spark, d), "enhancement_id", "enhanced_text")


@query(f"""
    WITH {_LINES}, n AS (SELECT id, line, line_no, lead(line) OVER (PARTITION BY id ORDER BY line_no) AS nx FROM l),
    j AS (SELECT *, line <> '' AND nx IS NOT NULL AND nx <> '' AND NOT {_ends('line')} AS joins FROM n),
    p AS (SELECT *, coalesce(sum((NOT joins)::INT) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM j),
    g AS (SELECT id, p, string_agg(CASE WHEN joins AND suffix(line, '-') THEN substring(line, 1, length(line) - 1) WHEN joins THEN line || ' ' ELSE line END, '' ORDER BY line_no) AS text, sum(joins::INT)::BIGINT AS joined, sum((joins AND suffix(line, '-'))::INT)::BIGINT AS hyphens FROM p WHERE line <> '' GROUP BY id, p)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS paragraph_no, text, joined, hyphens FROM g""")
def paragraph_normalize(spark: SparkSession, d: str) -> DataFrame:
    return L.join_lines(_enhanced(spark, d), "enhancement_id", "enhanced_text")


@query(f"""
    WITH {_LINES}, b AS (SELECT *, sum((line = '')::INT) OVER (PARTITION BY id ORDER BY line_no) AS p FROM l)
    SELECT id, min(line_no)::BIGINT AS first_line, count(*) AS n_lines, string_agg(line, ' ' ORDER BY line_no) AS text FROM b WHERE line <> '' GROUP BY id, p""")
def paragraph_segments(spark: SparkSession, d: str) -> DataFrame:
    return L.segments(_enhanced(spark, d), "enhancement_id", "enhanced_text")


def _headers_sql() -> str:
    parts = []
    for name, fam in P.HEADERS:
        hit = "CASE " + " ".join(f"WHEN {_has('line', p, i)} THEN {k}" for k, (p, i) in enumerate(fam)) + " END"
        number = "CASE "
        import re

        for k, (p, i) in enumerate(fam):
            groups = ", ".join(f"CASE WHEN regexp_matches(regexp_extract(line, {_q(re2(p, i))}, {n}), '^(?:[0-9]+|(?i:[IVXLCDM]+))\\z') THEN regexp_extract(line, {_q(re2(p, i))}, {n}) END" for n in range(1, re.compile(p).groups + 1))
            number += f"WHEN {_has('line', p, i)} THEN {f'coalesce({groups})' if groups else 'NULL'} "
        parts.append(f"SELECT id, line_no::BIGINT AS line_no, '{name}' AS type, ({hit})::BIGINT AS pattern_no, line, {number}END AS number, {2 if name == 'section' else 1}::BIGINT AS level FROM l WHERE line <> '' AND ({hit}) IS NOT NULL")
    return " UNION ALL ".join(parts)


@query(f"WITH {_LINES} {_headers_sql()}")
def line_classify(spark: SparkSession, d: str) -> DataFrame:
    return L.headers(_enhanced(spark, d), "enhancement_id", "enhanced_text")


@query(f"WITH {_LINES}, h AS ({_headers_sql()}) SELECT id, type, pattern_no, count(*) AS n, CASE WHEN count(*) > 1 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence, list(line ORDER BY line_no)[1:3] AS examples FROM h GROUP BY id, type, pattern_no")
def pattern_examples(spark: SparkSession, d: str) -> DataFrame:
    return L.header_statistics(L.headers(_enhanced(spark, d), "enhancement_id", "enhanced_text"))


_CONSISTENT = """
    k AS (SELECT id, type, number, CASE WHEN regexp_matches(number, '^[0-9]+\\z') THEN number::DECIMAL(38, 0) END AS n FROM h),
    jj AS (SELECT id, type, bool_or(n <> prev + 1) AS jump FROM (SELECT id, type, n, lag(n) OVER (PARTITION BY id, type ORDER BY n) AS prev FROM k WHERE n IS NOT NULL) WHERE prev IS NOT NULL GROUP BY id, type),
    cc AS (SELECT id, NOT bool_or(c > 1 AND (m < c OR coalesce(jump, false))) AS consistent FROM (SELECT id, type, count(*) AS c, count(number) AS m FROM k GROUP BY id, type) LEFT JOIN jj USING (id, type) GROUP BY id)
"""


@query(f"WITH {_LINES}, h AS ({_headers_sql()}), {_CONSISTENT} SELECT id, consistent FROM cc")
def numbering_consistency(spark: SparkSession, d: str) -> DataFrame:
    return L.consistent_numbering(L.headers(_enhanced(spark, d), "enhancement_id", "enhanced_text"))


_FN_HIT = "CASE " + " ".join(f"WHEN {_has('line', p)} THEN {k}" for k, p in enumerate(P.FOOTNOTES)) + " END"
_FN_REF = "nullif(CASE " + " ".join(f"WHEN {_has('line', p)} THEN regexp_extract(line, {_q(re2(p))}, 1)" for p in P.FOOTNOTES) + " END, '')"
_FN = f"fn AS (SELECT id, line_no::BIGINT AS line_no, ({_FN_HIT})::BIGINT AS pattern_no, {_FN_REF} AS reference, CASE WHEN regexp_matches({_FN_REF}, '^[0-9]+$') THEN 'numeric' WHEN regexp_matches({_FN_REF}, '^[A-Za-z]$') THEN 'alphabetic' WHEN regexp_matches(line, '[¹²³⁴⁵⁶⁷⁸⁹⁰]') THEN 'superscript' ELSE 'symbol' END AS type FROM l WHERE line <> '' AND ({_FN_HIT}) IS NOT NULL)"


@query(f"WITH {_LINES}, {_FN} SELECT * FROM fn")
def footnote_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.footnotes(_enhanced(spark, d), "enhancement_id", "enhanced_text")


@query(f"WITH {_LINES}, {_FN} SELECT id, pattern_no, type, count(*) AS n, arg_min(reference, line_no) AS first_reference FROM fn GROUP BY ALL")
def footnote_statistics(spark: SparkSession, d: str) -> DataFrame:
    return L.footnote_statistics(L.footnotes(_enhanced(spark, d), "enhancement_id", "enhanced_text"))


@query(f"""
    WITH {_LINES} SELECT id, line_no::BIGINT AS line_no, CASE WHEN {_has('raw', P.INDICATORS[0])} THEN 'numbered' WHEN {_has('raw', r'^\s*[\*\-•]\s+')} THEN 'bulleted' WHEN length(regexp_extract(raw, '^([ \\t]*)', 1)) >= 4 THEN 'indented' ELSE 'regular' END AS type,
    (length(regexp_extract(raw, '^([ \\t]*)', 1)) // 4)::BIGINT AS level FROM l WHERE line <> ''""")
def paragraph_types(spark: SparkSession, d: str) -> DataFrame:
    return L.paragraph_types(_enhanced(spark, d), "enhancement_id", "enhanced_text")


_A, _B = (re2(p) for p in P.DIALOGUES)


_DIALOGUES = f"""
    WITH t AS (SELECT doc_id AS id, text AS x FROM documents), l AS (SELECT id, {_trim('line')} AS line, no - 1 AS line_no FROM (SELECT id, unnest(string_split(x, chr(10))) AS line, unnest(range(1, len(string_split(x, chr(10))) + 1)) AS no FROM t))
    SELECT id, line_no::BIGINT AS line_no, CASE WHEN regexp_matches(line, {_q(_A)}) THEN regexp_extract(line, {_q(_A)}, 1) ELSE regexp_extract(line, {_q(_B)}, 1) END AS speaker, CASE WHEN regexp_matches(line, {_q(_A)}) THEN regexp_extract(line, {_q(_A)}, 2) ELSE regexp_extract(line, {_q(_B)}, 3) END AS speech,
           CASE WHEN regexp_matches(line, {_q(_A)}) THEN regexp_extract(line, {_q(_A)}, 2) ELSE regexp_extract(line, {_q(_B)}, 2) END AS note
    FROM l WHERE regexp_matches(line, {_q(_A)}) OR regexp_matches(line, {_q(_B)})"""


@query(_DIALOGUES)
def dialogues(spark: SparkSession, d: str) -> DataFrame:
    return L.dialogues(table(spark, d, "documents"), "doc_id", "text")


@query(f"""
    WITH d AS ({_DIALOGUES}), s AS (SELECT id, speaker, count(*) AS n, min(line_no) AS line_no FROM d GROUP BY id, speaker)
    SELECT id, sum(n)::BIGINT AS n_lines, count(*) AS n_speakers, list(speaker ORDER BY line_no, speaker)[1:5] AS speakers FROM s GROUP BY id""")
def dialogue_statistics(spark: SparkSession, d: str) -> DataFrame:
    return L.dialogue_statistics(L.dialogues(table(spark, d, "documents"), "doc_id", "text"))


@query(" UNION ALL ".join(f"SELECT id, '{n}' AS feature, count(*) AS n, arg_min(raw, line_no) AS first_example FROM (WITH {_LINES} SELECT * FROM l) WHERE {_has('raw', p, True)} GROUP BY id" for n, p in P.FEATURES))
def structure_features(spark: SparkSession, d: str) -> DataFrame:
    return L.features(_enhanced(spark, d), "enhancement_id", "enhanced_text")


@query(f"""
    WITH {_LINES}, h AS ({_headers_sql()}), {_CONSISTENT}, {_FN},
    t AS (SELECT id, replace(x, chr(10), ' ') AS flat FROM {_EL}),
    o AS (SELECT id, count(*) AS no FROM fn JOIN t USING (id) WHERE reference IS NOT NULL AND NOT contains(flat, '[' || reference || ']') AND NOT contains(flat, '(' || reference || ')') GROUP BY id),
    hs AS (SELECT id, count(*) AS nh, max(level) AS ml FROM h GROUP BY id)
    SELECT id, coalesce(nh, 0)::BIGINT AS n_headers, coalesce(ml, 0)::BIGINT AS max_level, coalesce(consistent, true) AS consistent, coalesce(no, 0)::BIGINT AS n_orphans,
           greatest(0, 100 - CASE WHEN coalesce(nh, 0) = 0 THEN 30 ELSE 0 END - CASE WHEN NOT coalesce(consistent, true) THEN 15 ELSE 0 END - 5 * coalesce(no, 0))::BIGINT AS score, round(least(1.0, coalesce(nh, 0) / 10), 6)::DOUBLE AS completeness
    FROM t LEFT JOIN hs USING (id) LEFT JOIN cc USING (id) LEFT JOIN o USING (id)""")
def structure_quality(spark: SparkSession, d: str) -> DataFrame:
    return L.structure_quality(_enhanced(spark, d), "enhancement_id", "enhanced_text")


# --- structure entries of books (B26-B29, B37, C3, C4, E5, E6, H15, H16, H28) ------------------
# entries as printed lists have them: numbered headings (every third one two levels deeper), numbered notes, and the first heading once more
_BOOKS = """m AS (SELECT book_key, arg_max({'s': book_structure, 'f': footnotes}, registered_at) AS v FROM manifests GROUP BY book_key),
    b AS (SELECT book_key, list_concat(list_transform(v.s, lambda x, i: i || CASE WHEN i % 3 = 0 THEN '.1.1 ' ELSE '. ' END || x), list_transform(list_filter(v.f, lambda x, i: i % 4 <> 2), lambda x: '§' || regexp_replace(x, '^\\[\\^([0-9]+)\\]: ', '\\1 ')), ['1. ' || v.s[1]]) AS s FROM m)"""
_ENT = f"{_BOOKS}, e AS (SELECT book_key, unnest(s) AS entry, unnest(range(0, len(s))) AS idx FROM b)"
_or = lambda x, rules: "(" + " OR ".join(_has(x, p, i) for p, i in rules) + ")"
_ET = _trim("entry")
_LEVEL = f"CASE WHEN {_has(_ET, r'^Chapter\s+\d+', True)} OR {_has(_ET, r'^Part\s+\d+', True)} OR {_has(_ET, r'^Book\s+\d+', True)} THEN 1 WHEN {_has(_ET, r'^Section\s+\d+', True)} THEN 2 ELSE least(len(regexp_extract_all({_ET}, '\\.')) + 1, 5) END"
_PNO = "coalesce(" + ", ".join(f"CASE WHEN {_has(_ET, p, i)} THEN try_cast(regexp_extract({_ET}, {_q(re2(p, i))}, 1) AS BIGINT) END" for p, i in P.PARAGRAPH_NUMBER) + ", 0)"
_CLS = f"{_ENT}, c AS (SELECT book_key, idx::BIGINT AS idx, entry, coalesce({_or(_ET, P.TOC_ENTRY)}, false) AS is_toc, coalesce({_or(_ET, P.PARAGRAPH_ENTRY)}, false) AS is_paragraph, ({_LEVEL})::BIGINT AS toc_level, ({_PNO})::BIGINT AS paragraph_no FROM e)"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifests").groupBy("book_key").agg(F.max_by(F.struct(F.col("book_structure").alias("s"), F.col("footnotes").alias("f")), "registered_at").alias("v"))
    heads = F.transform("v.s", lambda x, i: F.concat((i + 1).cast("string"), F.when((i + 1) % 3 == 0, ".1.1 ").otherwise(". "), x))
    notes = F.transform(F.filter("v.f", lambda x, i: (i + 1) % 4 != 2), lambda x: F.concat(F.lit("§"), F.regexp_replace(x, r"^\[\^([0-9]+)\]: ", "$1 ")))
    again = F.array(F.concat(F.lit("1. "), F.try_element_at("v.s", F.lit(1))))
    parts = F.concat(F.coalesce(heads, F.array().cast("array<string>")), F.coalesce(notes, F.array().cast("array<string>")), again)
    return S.entries(m.select("book_key", parts.alias("book_structure")), "book_key", "book_structure")


@query(f"WITH {_CLS} SELECT * FROM c")
def toc_levels(spark: SparkSession, d: str) -> DataFrame:
    return S.classify(_entries(spark, d)).withColumn("idx", F.col("idx").cast("long"))


@query(f"""
    WITH {_CLS}
    SELECT book_key, idx, unnest(list_filter([CASE WHEN entry IS NULL OR {_ET} = '' THEN 'blank' END, CASE WHEN is_toc AND length(entry) > 200 THEN 'toc_long' END, CASE WHEN is_toc AND length(entry) < 3 THEN 'toc_short' END,
        CASE WHEN is_paragraph AND length(entry) > 1000 THEN 'paragraph_long' END, CASE WHEN is_paragraph AND length(entry) < 10 THEN 'paragraph_short' END], lambda y: y IS NOT NULL)) AS warning FROM c
    UNION ALL SELECT book_key, idx, 'duplicate' FROM (SELECT *, row_number() OVER (PARTITION BY book_key, {_ET} ORDER BY idx) AS k FROM c WHERE entry IS NOT NULL) WHERE k > 1
    UNION ALL SELECT book_key, idx, 'hierarchy_jump' FROM (SELECT *, lag(toc_level) OVER (PARTITION BY book_key ORDER BY idx) AS p FROM c WHERE is_toc) WHERE toc_level > p + 1""")
def validate_structure(spark: SparkSession, d: str) -> DataFrame:
    return S.warnings(_entries(spark, d))


@query(f"""
    WITH {_CLS}, p AS (SELECT DISTINCT book_key, paragraph_no FROM c WHERE is_paragraph AND paragraph_no > 0),
    a AS (SELECT book_key, unnest(range(1, top + 1))::BIGINT AS missing FROM (SELECT book_key, max(paragraph_no) AS top FROM p GROUP BY book_key))
    SELECT book_key, missing FROM a ANTI JOIN p ON a.book_key = p.book_key AND a.missing = p.paragraph_no""")
def missing_numbers(spark: SparkSession, d: str) -> DataFrame:
    return S.missing_numbers(_entries(spark, d))


@query(f"""
    WITH {_CLS}, g AS (SELECT book_key, count(*) AS n_entries, count_if(is_toc)::BIGINT AS n_toc, count_if(is_paragraph)::BIGINT AS n_paragraphs FROM c GROUP BY book_key)
    SELECT *, array_to_string(list_filter([CASE WHEN n_toc = 0 THEN 'no_toc' END, CASE WHEN n_paragraphs = 0 THEN 'no_paragraphs' END, CASE WHEN n_toc > 0 AND n_paragraphs = 0 THEN 'add_paragraphs' END, CASE WHEN n_paragraphs > 0 AND n_toc = 0 THEN 'add_toc' END,
        CASE WHEN n_entries < 5 THEN 'very_few' END, CASE WHEN n_entries > 1000 THEN 'very_many' END], lambda y: y IS NOT NULL), ',') AS findings FROM g""")
def structure_completeness(spark: SparkSession, d: str) -> DataFrame:
    return S.completeness(_entries(spark, d))


@query(f"""
    WITH {_ENT}, p AS (SELECT book_key, idx::BIGINT AS idx, entry AS a, lead(entry) OVER (PARTITION BY book_key ORDER BY idx) AS b FROM e),
    w AS (SELECT *, lower({_trim('a')}) AS x, lower({_trim('b')}) AS y FROM p WHERE b IS NOT NULL AND a IS NOT NULL)
    SELECT book_key, idx, CASE WHEN x = y THEN 1.0 ELSE round(coalesce(len(list_filter({_words('x')}, lambda v: list_contains({_words('y')}, v)))::DOUBLE / nullif(greatest(len({_words('x')}), len({_words('y')})), 0), 0), 6) END::DOUBLE AS similarity FROM w""")
def common_words_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of neighbouring entries of a book's structure."""
    from pyspark.sql import Window

    e = _entries(spark, d)
    x = e.withColumn("b", F.lead("entry").over(Window.partitionBy("book_key").orderBy("idx"))).filter("b IS NOT NULL AND entry IS NOT NULL")
    return x.select("book_key", F.col("idx").cast("long").alias("idx"), S.similarity(F.col("entry"), F.col("b")).alias("similarity"))


_SP = "(SELECT DISTINCT page_id AS id, text_with_headers AS x FROM scan_pages)"


@query(f"""
    WITH l AS (SELECT id, {_trim('line')} AS line, no - 1 AS line_no FROM (SELECT id, unnest(string_split(string_split(x, '{P.FOOTNOTE_HEADING}')[1], chr(10))) AS line, unnest(range(1, len(string_split(string_split(x, '{P.FOOTNOTE_HEADING}')[1], chr(10))) + 1)) AS no FROM {_SP}))
    SELECT id, line_no::BIGINT AS line_no, CASE WHEN prefix(line, '#') THEN line ELSE array_to_string({_words('line')}[1:5], ' ') END AS entry FROM l WHERE line <> ''""")
def structure_entries(spark: SparkSession, d: str) -> DataFrame:
    return S.from_text(table(spark, d, "scan_pages").select("page_id", "text_with_headers").distinct(), "page_id", "text_with_headers")


@query(f"""
    WITH l AS (SELECT id, {_trim('line')} AS line, no - 1 AS line_no FROM (SELECT id, unnest(string_split(x, chr(10))) AS line, unnest(range(1, len(string_split(x, chr(10))) + 1)) AS no FROM (SELECT DISTINCT page_id AS id, footnote_text AS x FROM scan_pages)))
    SELECT id, line_no::BIGINT AS line_no, {_sub('line', r'^\[[MT]\]\s*', '')} AS entry FROM l WHERE line <> '' AND line <> '{P.FOOTNOTE_HEADING}'""")
def footnote_entries(spark: SparkSession, d: str) -> DataFrame:
    return S.footnote_entries(table(spark, d, "scan_pages").select("page_id", "footnote_text").distinct(), "page_id", "footnote_text")


# --- manifests (A16-A19, C11) --------------------------------------------------------------------
@query("SELECT book_key, arg_max(author, registered_at) AS author, arg_max(original.size, registered_at) AS size, max(registered_at) AS registered_at, count(*) AS registrations FROM (SELECT DISTINCT * FROM manifests) GROUP BY book_key")
def manifest_latest(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifests").distinct()
    return m.groupBy("book_key").agg(F.max_by("author", "registered_at").alias("author"), F.max_by("original.size", "registered_at").alias("size"), F.max("registered_at").alias("registered_at"), F.count("*").alias("registrations"))


@query("""
    WITH m AS (SELECT DISTINCT book_key, original.format AS f, original.size AS s, original.pages AS p, registered_at FROM manifests),
    o AS (SELECT book_key, arg_min((f, s, p), registered_at) AS v FROM m GROUP BY book_key), n AS (SELECT book_key, arg_max((f, s, p), registered_at) AS v FROM m GROUP BY book_key),
    j AS (SELECT o.book_key, o.v AS a, n.v AS b FROM o JOIN n USING (book_key))
    SELECT book_key, 'both' AS side, unnest(list_filter([CASE WHEN a[1] IS DISTINCT FROM b[1] THEN 'format' END, CASE WHEN a[2] IS DISTINCT FROM b[2] THEN 'size' END, CASE WHEN a[3] IS DISTINCT FROM b[3] THEN 'pages' END], lambda y: y IS NOT NULL)) AS field FROM j""")
def manifest_drift(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the file that changed between a book's first and newest registration."""
    m = table(spark, d, "manifests").select("book_key", "original.format", "original.size", "original.pages", "registered_at")
    g = m.groupBy("book_key").agg(*[f(F.struct("format", "size", "pages"), "registered_at").alias(k) for k, f in (("o", F.min_by), ("n", F.max_by))])
    side = lambda k: g.select("book_key", f"{k}.format", f"{k}.size", f"{k}.pages")
    return R.drift(side("o"), side("n"), "book_key", ["format", "size", "pages"])


@query("""
    SELECT DISTINCT book_key, regexp_extract(book_key, '^([^#]+)#', 1) AS author, regexp_extract(book_key, '^[^#]+#([^#]+)', 1) AS title, nullif(regexp_extract(book_key, '^[^#]+#[^#]+#([^#]+)$', 1), '') AS book_index,
           regexp_extract(book_key, '^([^#]+)#', 1) || '#' || regexp_extract(book_key, '^[^#]+#([^#]+)', 1) || coalesce('#' || nullif(regexp_extract(book_key, '^[^#]+#[^#]+#([^#]+)$', 1), ''), '') AS rebuilt
    FROM manifests""")
def parse_filename(spark: SparkSession, d: str) -> DataFrame:
    f = N.parse_filename(F.concat(F.lit("/in/"), F.replace(F.col("book_key"), F.lit(" "), F.lit("_")), F.lit(".pdf")))
    x = table(spark, d, "manifests").select("book_key").distinct().select("book_key", f["author"].alias("author"), f["title"].alias("title"), f["book_index"].alias("book_index"))
    return x.withColumn("rebuilt", N.book_key(F.col("author"), F.col("title"), F.col("book_index")))


# --- file formats (A3, B1-B11); small literal cases ---------------------------------------------
_FILES = [("a.pdf", "255044462D312E34", 1000, True), ("b.txt", "255044462D312E34", 1000, True), ("c.epub", "504B030414000000", 6000000, True), ("d.txt", "EFBBBF48616C6C6F", 10, False), ("e.txt", "48616C6C6F2057656C74", 10, False), ("f.bin", "0001020304050607", 10, False), ("g.txt", "", 0, False), ("h.txt", "FFFE48006100", 2000000, True)]


def _magic_sql() -> tuple[str, str]:
    h, t = "substring(h, 1, 8)", "length(regexp_replace(regexp_replace(h, '(..)', '\\1,', 'g'), '(09|0A|0D|[2-6][0-9A-F]|7[0-9A-E]|[89A-F][0-9A-F]),', '', 'g')) / 3"
    text = f"h <> '' AND 1 - ({t}) / (length(h) / 2) > 0.7"
    f = f"CASE WHEN {h} = '25504446' THEN 'pdf' WHEN {h} = '504B0304' THEN 'epub' WHEN prefix(h, 'EFBBBF') OR prefix(h, 'FFFE') OR ({text}) THEN 'txt' END"
    c = f"CASE WHEN {h} = '25504446' THEN 0.95 WHEN {h} = '504B0304' OR prefix(h, 'EFBBBF') OR prefix(h, 'FFFE') THEN 0.8 WHEN {text} THEN 0.6 ELSE 0.0 END"
    return f, c


def _files(spark: SparkSession) -> DataFrame:
    return _cases(spark, "files", _FILES, "name string, h string, size long, valid boolean").withColumn("header", F.unhex("h"))


@query(f"SELECT name, {_magic_sql()[0]} AS format, ({_magic_sql()[1]})::DOUBLE AS confidence FROM (VALUES {_values(_FILES)}) AS t(name, h, size, valid)")
def magic_numbers(spark: SparkSession, d: str) -> DataFrame:
    m = N.by_magic(F.col("header"))
    return _files(spark).select("name", m["format"].alias("format"), m["confidence"].alias("confidence"))


@query(f"""
    WITH t AS (SELECT name, size, valid, {_magic_sql()[0]} AS m, ({_magic_sql()[1]})::DOUBLE AS c, CASE WHEN regexp_extract(name, '\\.([^.]+)$', 1) IN ('pdf', 'epub', 'txt') THEN regexp_extract(name, '\\.([^.]+)$', 1) ELSE 'txt' END AS x FROM (VALUES {_values(_FILES)}) AS v(name, h, size, valid)),
    f AS (SELECT *, coalesce(m, x) AS format, size > CASE coalesce(m, x) WHEN 'pdf' THEN {P.SIZE_LIMITS['pdf']} WHEN 'epub' THEN {P.SIZE_LIMITS['epub']} ELSE {P.SIZE_LIMITS['txt']} END AS big FROM t)
    SELECT name, format, round(c * CASE WHEN format <> x THEN 0.8 ELSE 1 END * CASE WHEN big OR NOT valid THEN 0.5 ELSE 1 END, 6)::DOUBLE AS confidence, array_to_string(list_filter([CASE WHEN big THEN 'size' END, CASE WHEN NOT valid THEN 'content' END, CASE WHEN format <> x THEN 'mismatch' END], lambda y: y IS NOT NULL), ',') AS issues FROM f""")
def format_confidence(spark: SparkSession, d: str) -> DataFrame:
    r = N.decide_format(F.col("header"), F.col("name"), F.col("size"), F.col("valid"))
    return _files(spark).select("name", *[c.alias(k) for k, c in r.items()])


@query("""
    WITH m AS (SELECT book_key, arg_max(original.pages, registered_at) AS pages FROM manifests GROUP BY book_key), t AS (SELECT book_key, sum(length(extracted_text))::BIGINT AS n, count(ocr_text) AS images FROM (SELECT DISTINCT extraction_id, book_key, extracted_text, ocr_text FROM extractions) GROUP BY book_key),
    j AS (SELECT book_key, pages, n, images, least(100.0, n / least(pages, 5) / 200 * 100) AS cover FROM t JOIN m USING (book_key))
    SELECT book_key, CASE WHEN pages = 0 THEN 'empty' WHEN n < 100 THEN CASE WHEN images > 0 THEN 'image_based' ELSE 'empty' END WHEN images > 0 THEN CASE WHEN cover > 60 THEN 'hybrid' ELSE 'image_based' END ELSE 'text_based' END AS content_type,
           CASE WHEN pages > 0 THEN round(cover, 6) ELSE 0.0 END::DOUBLE AS coverage FROM j""")
def pdf_content_type(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifests").groupBy("book_key").agg(F.max_by("original.pages", "registered_at").alias("pages"))
    x = table(spark, d, "extractions").select("extraction_id", "book_key", "extracted_text", "ocr_text").distinct()
    t = x.groupBy("book_key").agg(F.sum(F.char_length("extracted_text")).alias("n"), F.count("ocr_text").alias("images"))
    r = N.pdf_content(F.col("pages"), F.col("n"), F.col("images"))
    return t.join(m, "book_key").select("book_key", r["content_type"].alias("content_type"), r["coverage"].alias("coverage"))


# --- chunks (E11, L3, D20) ----------------------------------------------------------------------
_SIZE, _OV = 500, 100
_SNAP = f"CASE WHEN least(@ + {_SIZE}, n) < n THEN coalesce(nullif(least(@ + {_SIZE}, n) - strpos(reverse(substring(x, greatest(least(@ + {_SIZE}, n) - 99, @ + 1), least(@ + {_SIZE}, n) + 2 - greatest(least(@ + {_SIZE}, n) - 99, @ + 1))), 'B') + 1, least(@ + {_SIZE}, n) + 1), least(@ + {_SIZE}, n)) ELSE n END"
_CHUNKS = f"""
    WITH RECURSIVE t(id, x, n, src) AS (SELECT extraction_id, regexp_replace(regexp_replace(extracted_text, '{NOT_WS}', 'x', 'g'), '[^x]', 'B', 'g'), length(extracted_text), extracted_text FROM (SELECT DISTINCT extraction_id, extracted_text FROM extractions) WHERE extracted_text <> ''),
    c(id, idx, pos, e) AS (
        SELECT id, 0, 0, {_SNAP.replace('@', '0')} FROM t
        UNION ALL SELECT id, idx + 1, np, {_SNAP.replace('@', 'np')} FROM (SELECT c.id, idx, t.x, t.n, CASE WHEN e - {_OV} <= pos THEN e ELSE e - {_OV} END AS np FROM c JOIN t USING (id)) WHERE np < n)
"""


@query(f"{_CHUNKS} SELECT c.id, idx::BIGINT AS idx, pos::BIGINT AS start_pos, e::BIGINT AS end_pos, substring(src, pos + 1, e - pos) AS content, CASE WHEN idx > 0 THEN {_OV} ELSE 0 END::BIGINT AS overlap_prev, CASE WHEN e < n THEN {_OV} ELSE 0 END::BIGINT AS overlap_next, len({_words('substring(src, pos + 1, e - pos)')})::BIGINT AS word_count, (e - pos)::BIGINT AS char_count FROM c JOIN t USING (id)")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "extractions").select("extraction_id", "extracted_text").distinct()
    return C.chunks(x, "extraction_id", "extracted_text", _SIZE, 20)


@query(f"{_CHUNKS} SELECT id, count(*) AS n_chunks, sum(CASE WHEN idx > 0 THEN {_OV} ELSE 0 END)::BIGINT AS total_overlap, round(avg(e - pos))::BIGINT AS average_size FROM c GROUP BY id")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.totals(chunks(spark, d))


@query(f"""
    SELECT DISTINCT chunk_id, char_count::BIGINT AS stored_chars, length(content)::BIGINT AS chars, word_count::BIGINT AS stored_words, len({_words('content')})::BIGINT AS words FROM text_chunks
    WHERE char_count IS DISTINCT FROM length(content) OR word_count IS DISTINCT FROM len({_words('content')})""")
def chunk_audit(spark: SparkSession, d: str) -> DataFrame:
    return C.audit(table(spark, d, "text_chunks"))


# --- model answers (C8, C9, D21, H33, L4); small literal cases -------------------------------------
_GOOD = '{"matchedEntries":[{"originalIndex":0,"correctedText":"Chapter 1: Introduction","confidence":0.95,"position":0}],"newEntries":[{"text":"Chapter 3: Conclusion","position":"after index 1","confidence":0.8}],"corrections":[{"index":1,"original":"Chapter 2","corrected":"Chapter 2: Main Content","confidence":0.9}],"confidence":0.88}'
_OTHER = '{"matchedEntries":[],"newEntries":[{"text":"Appendix","position":"end","confidence":0.5}],"corrections":[{"index":1,"original":"Chapter 2","corrected":"Chapter Two","confidence":0.9},{"index":0,"original":"Chapter 1: Introduction","corrected":"Chapter One","confidence":0.4}],"confidence":0.5}'
_ANSWERS = [("a", 0, _GOOD), ("a", 1, _OTHER), ("b", 0, _GOOD), ("b", 1, "no json"), ("c", 0, '{"confidence":1.0}'), ("d", 0, _GOOD), ("d", 1, _GOOD)]


def _answers(spark: SparkSession) -> DataFrame:
    return S.parse_responses(_cases(spark, "answers", _ANSWERS, "book_key string, chunk_no int, answer string"), "answer")


_PARSED = f"""
    WITH v AS (SELECT book_key, chunk_no, CASE WHEN json_valid(answer) THEN answer::JSON END AS j FROM (VALUES {_values(_ANSWERS)}) AS t(book_key, chunk_no, answer)),
    p AS (SELECT *, coalesce((j->'matchedEntries') IS NOT NULL AND (j->'newEntries') IS NOT NULL AND (j->'corrections') IS NOT NULL AND (j->'confidence') IS NOT NULL, false) AS ok FROM v)
"""


@query(f"{_PARSED} SELECT book_key, chunk_no, ok AS response_ok FROM p")
def llm_parse(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark).select("book_key", "chunk_no", "response_ok")


@query(f"""{_PARSED}, c AS (SELECT book_key, chunk_no, unnest(from_json(j->'corrections', '[{{"index":"BIGINT","corrected":"VARCHAR","confidence":"DOUBLE"}}]')) AS c FROM p WHERE ok)
    SELECT book_key, c.index AS idx, arg_max(c.corrected, c.confidence - chunk_no / 1000000.0) AS corrected, max(c.confidence) AS confidence FROM c GROUP BY book_key, c.index""")
def merge_responses(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_corrections(_answers(spark))


@query(f"""{_PARSED}, c AS (SELECT book_key, chunk_no, unnest(from_json(j->'matchedEntries', '[{{"originalIndex":"BIGINT","correctedText":"VARCHAR","confidence":"DOUBLE","position":"INTEGER"}}]')) AS c FROM p WHERE ok)
    SELECT book_key, c.originalIndex AS idx, arg_max(c.correctedText, c.confidence - chunk_no / 1000000.0) AS corrected, arg_max(c.position, c.confidence - chunk_no / 1000000.0) AS position, max(c.confidence) AS confidence FROM c GROUP BY book_key, c.originalIndex""")
def merge_matches(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_matches(_answers(spark))


@query(f"{_PARSED} SELECT book_key, count(*) AS n_chunks, sum(CASE WHEN ok THEN json_array_length(j->'newEntries') ELSE 0 END)::BIGINT AS n_new, round(avg(CASE WHEN ok THEN (j->>'confidence')::DOUBLE ELSE 0 END), 6) AS confidence FROM p GROUP BY book_key")
def merged_confidence(spark: SparkSession, d: str) -> DataFrame:
    return S.merged_confidence(_answers(spark))


@query()
def apply_corrections(spark: SparkSession, d: str) -> DataFrame:
    s = _cases(spark, "structures", [(k, ["Chapter 1: Introduction", "Chapter 2"]) for k in "abcd"], "book_key string, structure array<string>")
    return S.apply_responses(s, _answers(spark))


# --- layout (B14-B19, C6, C7, E7, E9, E10, D19, D30) ------------------------------------------------
_OL = "(SELECT doc_id, page_no, line_no, any_value(text) AS text, any_value(x0) AS x0, any_value(x1) AS x1, any_value(confidence) AS confidence FROM ocr_lines GROUP BY doc_id, page_no, line_no)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_lines").dropDuplicates(["doc_id", "page_no", "line_no"])


@query()
def x0_clusters(spark: SparkSession, d: str) -> DataFrame:
    return Y.clusters(_lines(spark, d))


@query()
def page_metrics(spark: SparkSession, d: str) -> DataFrame:
    return Y.metrics(_lines(spark, d)).select("doc_id", "page_no", F.explode("metrics").alias("m")).select("doc_id", "page_no", "m.type", "m.min_x0", "m.max_x0", "m.average_width", "m.max_width")


@query()
def range_classify(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d)
    return Y.line_types(x, Y.metrics(x)).select("doc_id", "page_no", "line_no", "line_type")


@query(f"SELECT doc_id, page_no, line_no, abs((x0 + x1) / 2 - {Y.PAGE_CENTRE}) <= {Y.CENTRE_TOLERANCE} AS centred FROM {_OL}")
def text_centred(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "page_no", "line_no", Y.centred(F.col("x0"), F.col("x1")).alias("centred"))


_ROMAN = "|".join(P.ROMAN)


@query(f"""
    SELECT doc_id, page_no, line_no, regexp_extract({_trim('text')}, '^({_ROMAN})\\. ([A-ZÄÖÜ«»-][^.]{{2,}}?)\\z', 1) AS number, regexp_extract({_trim('text')}, '^({_ROMAN})\\. ([A-ZÄÖÜ«»-][^.]{{2,}}?)\\z', 2) AS title, 'roman' AS pattern FROM {_OL} WHERE regexp_matches({_trim('text')}, '^({_ROMAN})\\. ([A-ZÄÖÜ«»-][^.]{{2,}}?)\\z')
    UNION ALL SELECT doc_id, page_no, line_no, regexp_extract({_trim('text')}, '^([0-9]+)\\. ([A-ZÄÖÜ«»-][^.]{{2,}}?)\\z', 1), regexp_extract({_trim('text')}, '^([0-9]+)\\. ([A-ZÄÖÜ«»-][^.]{{2,}}?)\\z', 2), 'decimal' FROM {_OL} WHERE regexp_matches({_trim('text')}, '^([0-9]+)\\. ([A-ZÄÖÜ«»-][^.]{{2,}}?)\\z')
    UNION ALL SELECT doc_id, page_no, line_no, NULL, regexp_extract({_trim('text')}, '^([A-ZÄÖÜ0-9][A-ZÄÖÜ «»-]*)\\z', 1), 'capitals' FROM {_OL} WHERE regexp_matches({_trim('text')}, '^([A-ZÄÖÜ0-9][A-ZÄÖÜ «»-]*)\\z')""")
def header_match(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d).select("doc_id", "page_no", "line_no", "text")
    out = None
    for name, pattern, number, title in (("roman", "{roman-number}. {title}", "roman-number", "title"), ("decimal", "{decimal-number}. {title}", "decimal-number", "title"), ("capitals", "{title-in-capital-letters}", None, "title-in-capital-letters")):
        hit, values = Y.match_header(F.col("text"), pattern)
        part = x.filter(hit).select("doc_id", "page_no", "line_no", (values[number] if number else F.lit(None).cast("string")).alias("number"), values[title].alias("title"), F.lit(name).alias("pattern"))
        out = part if out is None else out.union(part)
    return out


_MONTH = "(?:" + "|".join(P.MONTHS) + ")"
_PLACE, _DATE = r"[A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+)*", rf"\d{{1,2}}\.\s+{_MONTH}\s+\d{{4}}"
_FORMATS = {
    "roman": "{roman-number}.", "roman_title": "{roman-number} {title-in-capital-letters}", "capitals": "{title-in-capital-letters}", "decimal": "{decimal-number}. {title}", "numbered": "{title-with-decimal-number}",
    "open_end": "{no-paragraph-end-marker}", "place_date": "{place}, {long-date}", "place": "{place}", "lecture": "{german-ordinal} VORTRAG {place}, {long-date}",
}
#: the same conditions without look-ahead
_FORMATS_SQL = {
    "roman": _has("x", rf"^({_ROMAN})\.$"), "roman_title": _has("x", rf"^({_ROMAN}) [A-ZÄÖÜ0-9][A-ZÄÖÜ «»-]*$"), "capitals": _has("x", "^[A-ZÄÖÜ0-9][A-ZÄÖÜ «»-]*$"), "decimal": _has("x", r"^\d+\. [A-ZÄÖÜ«»-][^.]{2,}$"),
    "numbered": _has("x", r"^\d+\.\s+[A-ZÄÖÜ«»-][^.]{2,}$") + " AND NOT " + _has("x", rf"^\d+\.\s+{_MONTH}\b"),
    "open_end": "x <> '' AND NOT regexp_matches(x, '[0-9a-z]') AND NOT " + "(" + " OR ".join(f"suffix(x, '{m}')" for m in P.PARAGRAPH_ENDS) + ")",
    "place_date": _has("x", f"^{_PLACE}, {_DATE}$"), "place": _has("x", f"^{_PLACE}$"), "lecture": _has("x", f"^({'|'.join(P.ORDINALS)}) VORTRAG {_PLACE}, {_DATE}$"),
}


@query(f"WITH t AS (SELECT doc_id, page_no, line_no, {_trim('text')} AS x FROM {_OL}) " + " UNION ALL ".join(f"SELECT doc_id, page_no, line_no, '{k}' AS format FROM t WHERE {c}" for k, c in _FORMATS_SQL.items()))
def header_formats(spark: SparkSession, d: str) -> DataFrame:
    """Which formats, of all placeholders together, a line has (B14)."""
    hits = F.array_compact(F.array(*[F.when(Y.match_header(F.col("text"), p)[0], F.lit(k)) for k, p in _FORMATS.items()]))
    return _lines(spark, d).select("doc_id", "page_no", "line_no", F.explode(hits).alias("format"))


@query()
def page_fold(spark: SparkSession, d: str) -> DataFrame:
    return Y.fold_pages(table(spark, d, "ocr_lines"), Y.book_types(table(spark, d, "manifests")))


@query("""
    WITH p AS (SELECT DISTINCT book_key, page_no, text_with_headers AS t FROM scan_pages WHERE text_with_headers <> ''), n AS (SELECT *, lead(substring(t, 1, 1)) OVER (PARTITION BY book_key ORDER BY page_no) AS c FROM p)
    SELECT book_key, page_no, CASE WHEN c IS NULL THEN t WHEN suffix(t, '-') AND c = lower(c) THEN substring(t, 1, length(t) - 1) WHEN c = chr(10) THEN t ELSE t || ' ' END AS piece FROM n""")
def page_concat(spark: SparkSession, d: str) -> DataFrame:
    return Y.join_pages(table(spark, d, "scan_pages"))


@query(f"SELECT doc_id, page_no, count(*) AS n_lines, round(avg(confidence), 6) AS average_confidence, count_if(coalesce({_has('text', r'\.\s+[A-ZÄÖÜ]')}, false))::BIGINT AS n_restarts FROM {_OL} GROUP BY doc_id, page_no")
def page_profile(spark: SparkSession, d: str) -> DataFrame:
    return Y.page_profile(_lines(spark, d))


# --- removal patterns and the enhancer (H13, H14, H24, H26, D22, D27) ---------------------------------
_REMOVE = [r"/Copyright Archivverwaltung \w+ Buch: \d+ Seite: \d+/", r"/^\s*[-—] \d+ [-—]\s*$/", "Seite"]


@query(f"""
    SELECT DISTINCT page_id, replace({_sub(_sub('text_with_headers', _REMOVE[0][1:-1], ''), _REMOVE[1][1:-1], '')}, 'Seite', '') AS clean,
           ({_hits('text_with_headers', _REMOVE[0][1:-1])} + {_hits(_sub('text_with_headers', _REMOVE[0][1:-1], ''), _REMOVE[1][1:-1])} + (length({_sub(_sub('text_with_headers', _REMOVE[0][1:-1], ''), _REMOVE[1][1:-1], '')}) - length(replace({_sub(_sub('text_with_headers', _REMOVE[0][1:-1], ''), _REMOVE[1][1:-1], '')}, 'Seite', ''))) // 5)::BIGINT AS removed
    FROM scan_pages""")
def pattern_removal(spark: SparkSession, d: str) -> DataFrame:
    out, n = T.remove_patterns(F.col("text_with_headers"), _REMOVE, bare_is_regex=False)
    return table(spark, d, "scan_pages").select("page_id", out.alias("clean"), n.alias("removed")).distinct()


def _by_type_sql() -> str:
    """Removal patterns of each book type, one after the other; a look-ahead for one sign is said by its complement."""
    clean, n = "CASE", "CASE"
    for kind, c in P.BOOK_TYPES.items():
        x, hits = "text_with_headers", "0"
        for p in c["removal"]:
            body = p[1:-1].replace(r"(?!\^)[\s\S]+?", r"[^\^](?s:.)*?")
            hits += " + " + _hits(x, body)
            x = _sub(x, body, "")
        clean += f" WHEN kind = '{kind}' THEN {x}"
        n += f" WHEN kind = '{kind}' THEN {hits}"
    return f"{clean} ELSE text_with_headers END AS clean, ({n} WHEN text_with_headers IS NOT NULL THEN 0 END)::BIGINT AS removed"


@query(f"""
    WITH m AS (SELECT book_key, arg_max({{'t': original.book_type}}, registered_at) AS t FROM manifests GROUP BY book_key)
    SELECT page_id, book_key, kind, {_by_type_sql()} FROM (SELECT DISTINCT page_id, s.book_key, t.t AS kind, text_with_headers FROM scan_pages s LEFT JOIN m USING (book_key))""")
def pattern_removal_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Each page without what the removal patterns of its book's type match (A21, C10, J3)."""
    types = Y.book_types(table(spark, d, "manifests"))
    x = table(spark, d, "scan_pages").select("page_id", "book_key", "text_with_headers").distinct().join(types.withColumnRenamed("doc_id", "book_key"), "book_key", "left")
    out, n = Y.remove_by_type(x, "text_with_headers")
    return x.select("page_id", "book_key", F.col("book_type").alias("kind"), out.alias("clean"), n.alias("removed"))


@query("""
    SELECT extraction_id, count(*) AS n, coalesce(sum(issues_fixed), 0)::BIGINT AS fixed, coalesce(sum(issues_remaining), 0)::BIGINT AS remaining, coalesce(sum(enhancement_summary.spelling_corrections), 0)::BIGINT AS spelling, coalesce(sum(enhancement_summary.debris_removed), 0)::BIGINT AS debris,
           coalesce(sum(enhancement_summary.words_reconstructed), 0)::BIGINT AS words, coalesce(sum(enhancement_summary.characters_fixed), 0)::BIGINT AS characters, round(coalesce(avg(confidence), 1.0), 6) AS confidence
    FROM (SELECT DISTINCT * FROM enhancements) GROUP BY extraction_id""")
def enhancement_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.enhancement_summary(table(spark, d, "enhancements").distinct())


@query()
def issue_list(spark: SparkSession, d: str) -> DataFrame:
    return H.issues(table(spark, d, "extractions").select("extraction_id", "ocr_text").distinct(), "extraction_id", "ocr_text")


@query()
def enhance_text(spark: SparkSession, d: str) -> DataFrame:
    return H.enhance(table(spark, d, "extractions").select("extraction_id", "ocr_text").distinct(), "extraction_id", "ocr_text")


@query()
def preprocess_text(spark: SparkSession, d: str) -> DataFrame:
    return H.preprocess(table(spark, d, "scan_pages"), "page_id", "text_with_headers", _REMOVE)


@query(f"""
    SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS lines, len({_words('text')})::BIGINT AS words, length(text)::BIGINT AS chars, regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') AS has_control,
           CASE WHEN {_hint_sql(P.GERMAN_HINTS)} > {_hint_sql(P.ENGLISH_HINTS)} THEN 'de' WHEN {_hint_sql(P.ENGLISH_HINTS)} > {_hint_sql(P.GERMAN_HINTS)} THEN 'en' WHEN text IS NOT NULL THEN 'auto' END AS language FROM documents""")
def text_info(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in T.info(F.col("text")).items()])


@query(f"""
    WITH {_LINES}, h AS ({_headers_sql()}), g AS (SELECT id, max(level) AS max_level, count(*) AS n_headers, count_if(type = 'chapter')::BIGINT AS n_chapters, count_if(type = 'lecture')::BIGINT AS n_lectures, count_if(type = 'section')::BIGINT AS n_sections,
        list_distinct(list(CASE WHEN regexp_matches(number, '^[0-9]+$') THEN 'numeric' WHEN regexp_matches(number, '(?i)^[IVXLCDM]+$') THEN 'roman' WHEN regexp_matches(number, '(?i)^[A-Z]$') THEN 'alphabetic' END)) AS s FROM h GROUP BY id)
    SELECT id, max_level, n_headers, n_chapters, n_lectures, n_sections, CASE len(list_filter(s, lambda y: y IS NOT NULL)) WHEN 0 THEN 'numeric' WHEN 1 THEN list_filter(s, lambda y: y IS NOT NULL)[1] ELSE 'mixed' END AS numbering_style FROM g""")
def structure_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return L.hierarchy(L.headers(_enhanced(spark, d), "enhancement_id", "enhanced_text"))


@query(f"""
    WITH {_CLS}, t AS (SELECT *, {_ET} AS x FROM c WHERE entry IS NOT NULL)
    SELECT book_key, idx, array_to_string(list_filter([CASE WHEN NOT {_or('x', [(r'^[0-9]+[.]', False), (r'^Chapter[ ]+[0-9]+', True)])} THEN 'start' END, CASE WHEN length(entry) > 100 THEN 'length' END], lambda y: y IS NOT NULL), ',') AS errors,
           CASE WHEN length(entry) > 100 THEN substring(entry, 1, 100) || '...' WHEN NOT {_or('x', [(r'^[0-9]+[.]', False), (r'^Chapter[ ]+[0-9]+', True)])} THEN '1. ' || x ELSE entry END AS suggestion FROM t""")
def toc_format(spark: SparkSession, d: str) -> DataFrame:
    f = S.suggested_format(F.col("entry"), paragraph=False)
    return _entries(spark, d).filter("entry IS NOT NULL").select("book_key", F.col("idx").cast("long").alias("idx"), f["errors"].alias("errors"), f["suggestion"].alias("suggestion"))


@query(f"""
    WITH l AS (SELECT page_id, {_trim('line')} AS line FROM (SELECT page_id, unnest(string_split(text_with_headers, chr(10))) AS line FROM (SELECT DISTINCT page_id, text_with_headers FROM scan_pages)) WHERE prefix(line, '#'))
    SELECT page_id, line, coalesce(r.n, try_cast(nullif(regexp_extract(line, '([0-9]+)', 1), '') AS INT))::BIGINT AS number
    FROM l LEFT JOIN (VALUES {_values(list(P.ROMAN.items()))}) AS r(k, n) ON r.k = regexp_extract(line, '\\b({"|".join(P.ROMAN)})\\b', 1)""")
def heading_ordinals(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "scan_pages").select("page_id", "text_with_headers").distinct().select("page_id", F.explode(F.split("text_with_headers", "\n")).alias("line"))
    x = x.filter(F.col("line").startswith("#")).withColumn("line", T.trim(F.col("line")))
    return x.select("page_id", "line", Y.ordinal(F.col("line")).alias("number"))


@query("""
    WITH m AS (SELECT book_key, arg_max(original.size, registered_at) AS size FROM manifests GROUP BY book_key), t AS (SELECT book_key, sum(length(extracted_text))::BIGINT AS chars, count(*) AS sections FROM (SELECT DISTINCT extraction_id, book_key, extracted_text FROM extractions) GROUP BY book_key)
    SELECT book_key, sections, chars, round(chars::DOUBLE / nullif(size, 0), 6) AS compression_ratio FROM t JOIN m USING (book_key)""")
def extraction_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Characters of a book's text against the size of its file (D29)."""
    m = table(spark, d, "manifests").groupBy("book_key").agg(F.max_by("original.size", "registered_at").alias("size"))
    t = table(spark, d, "extractions").select("extraction_id", "book_key", "extracted_text").distinct().groupBy("book_key").agg(F.sum(F.char_length("extracted_text")).alias("chars"), F.count("*").alias("sections"))
    return t.join(m, "book_key").select("book_key", "sections", "chars", F.round(F.col("chars") / F.nullif(F.col("size"), F.lit(0)), 6).alias("compression_ratio"))


# --- run logs (D23-D25, D29, E12, H29, H30) -------------------------------------------------------------
@query("SELECT event_type, count(*) AS n, count_if(value >= 50)::BIGINT AS n_done, round(count_if(value >= 50) / count(*), 6) AS success_rate, round(sum(value), 2) AS total, round(avg(value), 4) AS average FROM events GROUP BY event_type")
def run_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("status", F.when(F.col("value") >= 50, "done").otherwise("failed"))
    r = R.roll_up(e, "event_type", "status", "value", "done")
    return r.withColumn("total", F.round("total", 2)).withColumn("average", F.round("average", 4))


_DUR = "CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms // 1000 < 60 THEN (ms // 1000) || 's' WHEN ms // 1000 < 3600 THEN (ms // 60000) || 'm ' || (ms // 1000 % 60) || 's' ELSE (ms // 3600000) || 'h ' || (ms // 1000 % 3600 // 60) || 'm ' || (ms // 1000 % 60) || 's' END"


@query(f"SELECT DISTINCT enhancement_id, processing_time, {_DUR} AS duration, 'Enhanced in ' || {_DUR} AS message FROM (SELECT enhancement_id, processing_time, processing_time * 4711 AS ms FROM enhancements WHERE processing_time IS NOT NULL)")
def format_duration(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "enhancements").filter("processing_time IS NOT NULL").select("enhancement_id", "processing_time", T.duration(F.col("processing_time") * 4711).alias("duration")).distinct()
    return x.withColumn("message", T.fill_template(F.lit("Enhanced in {duration}"), {"duration": F.col("duration")}))


@query("""
    SELECT DISTINCT book_key, page_no, CASE WHEN coalesce(level1_headings_index, 0) <> 0 THEN level1_headings_index::DOUBLE WHEN top > 0 THEN round(100.0 * page_no / top, 6) ELSE 0.0 END::DOUBLE AS percentage
    FROM (SELECT book_key, page_no, level1_headings_index, max(page_no) OVER (PARTITION BY book_key) AS top FROM scan_pages)""")
def progress(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "scan_pages").select("book_key", "page_no", "level1_headings_index")
    top = p.groupBy("book_key").agg(F.max("page_no").alias("top"))
    return p.join(top, "book_key").select("book_key", "page_no", R.percent(F.col("page_no"), F.col("top"), F.col("level1_headings_index")).alias("percentage")).distinct()
