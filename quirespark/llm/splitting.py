"""Problem 2: splitting oversized items at natural boundaries.

Method: pointer doubling. Every boundary of a text (paragraph, sentence, word
end) is joined to its farthest legal successor, the end of the next piece when
a piece ends here: the next piece starts ``overlap`` code points back, so the
successor lies at most ``size - overlap`` ahead. Squaring the successor table
(``next = next[next]``) while marking what is reached gives all greedy cuts in
log2(pieces) steps, each one vectorised pass over the table; nothing walks
from cut to cut, not even where no boundary is in reach. A text's table lives in one Arrow row, so there is no shuffle.

Rules. A piece ends at the best kind of boundary in reach, paragraph before
sentence before word, and of that kind at the farthest; paragraph and sentence
ends count only in the last half of the reach, else the next kind is taken, so
that pieces stay long; where no boundary at all is in reach the piece is cut at
the size limit. Each piece shares exactly ``floor(size * overlap / 100)`` code
points with the piece before and is never longer than the size; together the
pieces cover the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"[.!?…]+[\"'»«”’)\]]*(?=\s)")
_WORD = re.compile(r"\S(?=\s)")


def _ends(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets after which a piece may end, by kind; the white space after an end opens the next piece."""
    arr = lambda it: np.fromiter(it, np.int64)
    return arr(m.end() for m in _PARAGRAPH.finditer(text)), arr(m.end() for m in _SENTENCE.finditer(text)), arr(m.end() for m in _WORD.finditer(text))


def _farthest(ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest of ``ends`` in (low, high], or -1."""
    if not len(ends):
        return np.full(len(low), -1, np.int64)
    at = np.searchsorted(ends, high, side="right") - 1
    got = ends[np.maximum(at, 0)]
    return np.where((at >= 0) & (got > low), got, -1)


def _successors(nodes: np.ndarray, n: int, size: int, overlap: int, kinds: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where the next piece ends, for a piece that ends at each node (node 0: before the first piece)."""
    start = np.where(nodes > 0, nodes - overlap, 0)
    high = np.minimum(start + size, n)
    least = np.where(nodes > 0, nodes, overlap)  # the first piece must hold more than what it shares
    half = np.maximum(least, start + size // 2)
    out = np.where(start + size >= n, n, -1)
    for ends, low in ((kinds[0], half), (kinds[1], half), (kinds[2], least), (kinds[1], least), (kinds[0], least)):
        out = np.where(out < 0, _farthest(ends, low, high), out)
    return np.where(out < 0, high, out)


def cut_points(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` of all pieces; one piece for a text within the size, none for an empty one."""
    n = len(text)
    if not n:
        return []
    if n <= size:
        return [(0, n)]
    kinds = _ends(text)
    nodes = np.unique(np.concatenate([np.array([0, n], np.int64), *kinds]))
    nxt = _successors(nodes, n, size, overlap, kinds)
    nxt[-1] = n
    hard = ~np.isin(nxt, nodes)
    if hard.any():
        # no boundary in reach: the cuts run on in equal steps to the boundary that ends the stretch, so all are known at once
        step, first = size - overlap, nxt[hard]
        last = nodes[np.searchsorted(nodes, first, side="right")]
        count = (last - first - 1) // step + 1
        new = np.unique(np.repeat(first, count) + step * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)))
        order = np.argsort(np.concatenate([nodes, new]), kind="stable")
        nxt = np.concatenate([nxt, _successors(new, n, size, overlap, kinds)])[order]
        nodes = np.concatenate([nodes, new])[order]
    jump = np.searchsorted(nodes, nxt)
    reached = np.zeros(len(nodes), bool)
    reached[0] = True
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        jump = jump[jump]
        if (more == reached).all():
            break
        reached = more
    ends = nodes[reached][1:]
    starts = np.concatenate([[0], ends[:-1] - overlap])
    return list(zip(starts.tolist(), ends.tolist()))


def overlap_of(size: int, percentage: int | None) -> int:
    """Whole code points of overlap; at least one code point of a piece is new."""
    return max(0, min(size - 1, size * min(max(percentage or 0, 0), 100) // 100))


def oversized(chunks: DataFrame, options: DataFrame, default_options: int = 1) -> DataFrame:
    """``chunk_id, content, size, overlap_percentage, max_chunks`` of chunks longer than their options allow.

    A null ``options_id`` means ``default_options``; chunks with null content or
    unknown options are no case; of a chunk delivered several times the newest
    delivery counts, if there is a ``created_at``. The options are a parameter
    table with one row per id. Natural ends are sought whatever the options
    say about words.
    """
    opt = options.select(F.col("options_id").alias("oid"), F.col("chunk_size").alias("size"), "overlap_percentage", "max_chunks").filter("size > 0").dropDuplicates(["oid"])
    when = F.col("created_at").cast("timestamp_ntz") if "created_at" in chunks.columns else F.lit(None).cast("timestamp_ntz")
    c = chunks.filter("chunk_id IS NOT NULL").select("chunk_id", "content", F.coalesce(F.col("options_id"), F.lit(default_options)).cast("long").alias("oid"), when.alias("when"))
    c = c.join(opt, "oid", "left").withColumn("over", F.coalesce(F.char_length("content") > F.col("size"), F.lit(False)))
    # only what is too long travels as text
    one = F.struct("when", "over", F.when(F.col("over"), F.col("content")).alias("content"), "size", "overlap_percentage", "max_chunks")
    best = c.groupBy("chunk_id").agg(F.max_by(one, F.coalesce("when", F.lit("0001-01-01").cast("timestamp_ntz"))).alias("c"))
    return best.filter("c.over").select("chunk_id", "c.content", "c.size", "c.overlap_percentage", "c.max_chunks")


def split(chunks: DataFrame, options: DataFrame, default_options: int = 1) -> DataFrame:
    """``chunk_id, piece_no, start_pos, end_pos, content, overlap_prev, beyond_max``: pieces of the oversized chunks.

    ``beyond_max`` marks pieces past the options' ``max_chunks``; none is dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, size, pct, most in zip(b["chunk_id"], b["content"], b["size"], b["overlap_percentage"], b["max_chunks"]):
                size = int(size)
                overlap = overlap_of(size, None if pd.isna(pct) else int(pct))
                for k, (s, e) in enumerate(cut_points(t, size, overlap)):
                    rows.append((i, k, s, e, t[s:e], overlap if k else 0, bool(pd.notna(most) and k >= most)))
            yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "start_pos", "end_pos", "content", "overlap_prev", "beyond_max"])

    return oversized(chunks, options, default_options).mapInPandas(run, "chunk_id long, piece_no int, start_pos int, end_pos int, content string, overlap_prev int, beyond_max boolean")


def found(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """Chunks that the splitter had to cut: those with a second piece."""
    return split(chunks, options).filter("piece_no = 1").select("chunk_id").distinct()
