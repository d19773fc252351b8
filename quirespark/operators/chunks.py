"""Overlapping windows over texts, with optional snapping to word ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions import text as T

LOOK_BACK = 100
_STOPS = frozenset("\t\n\x0b\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff") | frozenset(map(chr, range(0x2000, 0x200B)))


def bounds(text: str, size: int, percentage: int, snap: bool, max_chunks: int | None = None) -> list[tuple[int, int]]:
    """Windows of ``size``; the next one starts the overlap before the end of the last.

    With snapping an end moves back to the nearest blank, at most LOOK_BACK
    characters, the cut itself included. Behind a last window longer than the
    overlap there is one more that repeats it, as there always was.
    """
    n, pos, out = len(text), 0, []
    overlap = size * percentage // 100
    while pos < n and (max_chunks is None or len(out) < max_chunks):
        end = min(pos + size, n)
        if snap and end < n:
            at = next((k for k in range(end, max(end - LOOK_BACK, pos) - 1, -1) if text[k] in _STOPS), None)
            end = at if at is not None and at > pos else end
        out.append((pos, end))
        pos = end if end - overlap <= pos else end - overlap
    return out


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = 5000, percentage: int = 20, snap: bool = True, max_chunks: int | None = None) -> DataFrame:
    """``id, idx, start_pos, end_pos, content, overlap_prev, overlap_next, word_count, char_count``; null and empty texts have no chunk."""
    if size < 1 or not 0 <= percentage <= 100 or max_chunks is not None and max_chunks < 1:
        raise ValueError("size must be positive, percentage 0 to 100, max_chunks positive")
    overlap = size * percentage // 100

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["t"]):
                for k, (s, e) in enumerate(bounds(t, size, percentage, snap, max_chunks)):
                    rows.append((i, k, s, e, t[s:e], overlap if k else 0, overlap if e < len(t) else 0))
            yield pd.DataFrame(rows, columns=["id", "idx", "start_pos", "end_pos", "content", "overlap_prev", "overlap_next"])

    x = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).filter("t IS NOT NULL AND t != ''")
    got = x.mapInPandas(run, "id long, idx long, start_pos long, end_pos long, content string, overlap_prev long, overlap_next long")
    return got.withColumns({"word_count": T.word_count(F.col("content")), "char_count": F.char_length("content").cast("long")})


def totals(c: DataFrame) -> DataFrame:
    """``id, n_chunks, total_overlap, average_size``."""
    return c.groupBy("id").agg(F.count("*").alias("n_chunks"), F.sum("overlap_prev").alias("total_overlap"), F.round(F.avg("char_count")).cast("long").alias("average_size"))


def audit(stored: DataFrame) -> DataFrame:
    """``chunk_id, stored_chars, chars, stored_words, words``: stored counts that differ from the content; a chunk delivered twice is one row."""
    x = stored.select("chunk_id", F.col("char_count").cast("long").alias("stored_chars"), F.char_length("content").cast("long").alias("chars"), F.col("word_count").cast("long").alias("stored_words"), T.word_count(F.col("content")).alias("words"))
    return x.filter("NOT (stored_chars <=> chars) OR NOT (stored_words <=> words)").distinct()
