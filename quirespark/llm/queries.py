"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import leakage, lookalikes, mixing, quality, residue, scan_repair, shared_spans, splitting
from quirespark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
TEXTS = ["extracted_text", "ocr_text"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.found(table(spark, d, "enhancements"))


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_statistics(table(spark, d, "enhancements"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(table(spark, d, "enhancements"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(table(spark, d, "text_chunks"), table(spark, d, "chunk_options"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "text_chunks"), table(spark, d, "chunk_options"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.found(table(spark, d, "extractions"), "extraction_id", TEXTS)


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.spans(table(spark, d, "extractions"), "extraction_id", TEXTS, "loaded_at")


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.coverage(table(spark, d, "extractions"), "extraction_id", TEXTS, "loaded_at")


def p3_removed(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.removed(table(spark, d, "extractions"), "extraction_id", TEXTS, "loaded_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.found(table(spark, d, "extractions"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.repaired(table(spark, d, "extractions"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.classes(table(spark, d, "extractions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.found(table(spark, d, "extractions"), table(spark, d, "ocr_results"), table(spark, d, "scan_pages"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repaired(table(spark, d, "extractions"), table(spark, d, "ocr_results"), table(spark, d, "scan_pages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_capped_shares(spark: SparkSession, d: str) -> DataFrame:
    """Three times the largest mixture without a binding cap, so that small sources reach theirs."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"), fill=3.0)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "documents"))


def p8_flagged(spark: SparkSession, d: str) -> DataFrame:
    return residue.flagged(table(spark, d, "documents"))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.kept(table(spark, d, "documents")).select("doc_id", F.char_length("text").alias("text_length"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_statistics, p1_classes, p2_found, p2_pieces, p3_found, p3_spans, p3_coverage, p3_removed, p4_found, p4_repaired, p4_classes, p5_found, p5_repaired, p6_found, p6_report, p7_mix, p7_shares, p7_capped_shares, p8_found, p8_flagged, p8_kept)}


_COMMON = ", ".join(f"'{w}'" for w in sorted(quality.COMMON))


_quoted = lambda p: "'" + p.replace("'", "''").replace(r"\s", r"[ \t\n\x0b\f\r]").replace(r"\S", r"[^ \t\n\x0b\f\r]") + "'"
_ENDED, _LISTED = _quoted(quality._ENDED), _quoted(quality._LIST_LINE)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_statistics": rf"""
            WITH t AS (
                SELECT enhancement_id, enhanced_text AS x, regexp_extract_all(lower(enhanced_text), '\p{{L}}+') AS w,
                       list_filter(string_split(enhanced_text, chr(10)), lambda y: regexp_matches(y, '[^ \t\n\x0b\f\r]')) AS l,
                       length(regexp_replace(enhanced_text, '[ \t\n\x0b\f\r]+', '', 'g')) AS visible,
                       length(regexp_replace(enhanced_text, '[^\p{{L}}]+', '', 'g')) AS letters,
                       length(regexp_replace(enhanced_text, '[^0-9]+', '', 'g')) AS digits
                FROM enhancements),
            c AS (SELECT *, len(list_filter(w, lambda y: y IN ({_COMMON}))) AS common, len(list_filter(l, lambda y: regexp_matches(y, {_ENDED}))) AS ended, len(list_filter(l, lambda y: regexp_matches(y, {_LISTED}))) AS listed FROM t)
            SELECT enhancement_id,
                   CAST(length(x) AS BIGINT) AS n_chars,
                   CAST(len(regexp_extract_all(x, '[^ \t\n\x0b\f\r]+')) AS BIGINT) AS n_tokens,
                   CAST(len(w) AS BIGINT) AS n_words,
                   CAST(len(l) AS BIGINT) AS n_lines,
                   CASE WHEN x IS NOT NULL THEN round(coalesce(letters / nullif(len(w), 0), 0), 6) END AS mean_word_length,
                   CASE WHEN x IS NOT NULL THEN round(coalesce((visible - letters - digits) / nullif(visible, 0), 0), 6) END AS symbol_ratio,
                   CASE WHEN x IS NOT NULL THEN round(coalesce(digits / nullif(visible, 0), 0), 6) END AS digit_ratio,
                   CASE WHEN x IS NOT NULL THEN round(coalesce(letters / nullif(visible, 0), 0), 6) END AS letter_ratio,
                   CASE WHEN x IS NOT NULL THEN round(coalesce(ended / nullif(len(l), 0), 0), 6) END AS punct_line_share,
                   CASE WHEN x IS NOT NULL THEN round(coalesce(listed / nullif(len(l), 0), 0), 6) END AS list_line_share,
                   CASE WHEN x IS NOT NULL THEN round(coalesce(common / nullif(len(w), 0), 0), 6) END AS common_share,
                   CASE WHEN x IS NOT NULL THEN round(coalesce(100 * common / nullif(length(x), 0), 0), 6) END AS common_per_100,
                   CASE WHEN x IS NOT NULL THEN round(coalesce(100 * len(w) / nullif(length(x), 0), 0), 6) END AS words_per_100,
                   CASE WHEN x IS NOT NULL THEN round(coalesce(len(list_distinct(w)) / nullif(len(w), 0), 0), 6) END AS distinct_share
            FROM c""",
        "p2_found": """
            SELECT DISTINCT c.chunk_id FROM text_chunks c JOIN chunk_options o ON o.options_id = coalesce(c.options_id, 1)
            WHERE length(c.content) > o.chunk_size""",
        "p3_found": """
            WITH x AS (SELECT extraction_id, unnest([extracted_text, ocr_text]) AS t FROM extractions),
            w AS (SELECT extraction_id, hash(substring(t, CAST(i AS BIGINT), 240)) AS h FROM (SELECT extraction_id, t, unnest(range(1, length(t) - 238)) AS i FROM x WHERE length(t) >= 240)),
            s AS (SELECT h FROM w GROUP BY h HAVING min(extraction_id) < max(extraction_id))
            SELECT DISTINCT extraction_id FROM w SEMI JOIN s USING (h)""",
        "p6_found": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
            i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
            dw AS (SELECT doc_id, array_to_string(list_slice(w, CAST(k AS BIGINT), CAST(k + 12 AS BIGINT)), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
            iw AS (SELECT item_id, array_to_string(list_slice(w, CAST(k AS BIGINT), CAST(k + 12 AS BIGINT)), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13))
            SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
        "p6_report": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
            i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM eval_items),
            dw AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, CAST(k AS BIGINT), CAST(k + 12 AS BIGINT)), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
            iw AS (SELECT item_id, k, array_to_string(list_slice(w, CAST(k AS BIGINT), CAST(k + 12 AS BIGINT)), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13)),
            m AS (SELECT doc_id, item_id, k FROM dw JOIN iw USING (g)),
            h AS (SELECT item_id, count(DISTINCT doc_id) AS nd, count(DISTINCT k) AS nw FROM m GROUP BY item_id),
            c AS (SELECT item_id, count(DISTINCT p) AS covered FROM (SELECT item_id, unnest(range(k, k + 13)) AS p FROM m) GROUP BY item_id)
            SELECT item_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(nd, 0) AS BIGINT) AS n_documents, CAST(coalesce(nw, 0) AS BIGINT) AS n_windows, round(coalesce(covered / nullif(len(w), 0), 0), 6) AS leaked_share
            FROM i LEFT JOIN h USING (item_id) LEFT JOIN c USING (item_id)""",
        "p3_coverage": """
            WITH x AS (SELECT DISTINCT extraction_id, extracted_text AS a, ocr_text AS b, loaded_at FROM extractions),
            r AS (SELECT extraction_id, min(loaded_at) AS ts, max(length(coalesce(a, '')) + length(coalesce(b, ''))) AS n_chars FROM x GROUP BY extraction_id),
            t AS (SELECT DISTINCT extraction_id, 0 AS f, a AS t FROM x WHERE length(a) >= 240 UNION SELECT DISTINCT extraction_id, 1, b FROM x WHERE length(b) >= 240),
            w AS (SELECT extraction_id, f, i, hash(substring(t, CAST(i AS BIGINT), 240)) AS h FROM (SELECT extraction_id, f, t, unnest(range(1, length(t) - 238)) AS i FROM t)),
            s AS (SELECT h, arg_min(extraction_id, (coalesce(ts, TIMESTAMP '9999-01-01'), extraction_id)) AS first_id FROM w JOIN r USING (extraction_id) GROUP BY h HAVING min(extraction_id) < max(extraction_id)),
            m AS (SELECT DISTINCT extraction_id, f, i, first_id <> extraction_id AS later FROM w JOIN s USING (h)),
            g AS (SELECT extraction_id, f, i, later, coalesce(i - lag(i) OVER (PARTITION BY extraction_id, f ORDER BY i), 240) AS new, CASE WHEN later THEN coalesce(i - lag(i) OVER (PARTITION BY extraction_id, f, later ORDER BY i), 240) END AS new_later FROM m),
            c AS (SELECT extraction_id, sum(least(240, new)) AS shared, sum(CASE WHEN later THEN least(240, new_later) ELSE 0 END) AS removable FROM g GROUP BY extraction_id)
            SELECT extraction_id, CAST(n_chars AS BIGINT) AS n_chars, CAST(coalesce(shared, 0) AS BIGINT) AS shared_chars, CAST(coalesce(removable, 0) AS BIGINT) AS removable_chars, round(coalesce(shared / nullif(n_chars, 0), 0), 6) AS shared_share
            FROM r LEFT JOIN c USING (extraction_id)""",
    }
