"""Problem 3: long exact spans shared between records.

Method: line and paragraph hashing. A field is cut into units at natural
starts (line starts and sentence starts; in stretches of ``GAP`` or more
without one, at content-chosen positions). A unit is the text from such a
start, long enough (``UNIT`` code points, running into the following lines)
to be telling. Digests of units are grouped over the whole corpus; units held
by two or more records are candidates, the earliest ranked holder is the
original and every other occurrence carries its offsets so that it can be
removed.

Exactness. With ``UNIT + GAP <= min_len``, every span of ``min_len`` code
points has a unit start among its first ``GAP`` code points and the whole unit
inside itself; line and sentence starts are decided by the characters beside
them, and the content-chosen ones by windows that lie inside the stretch, so
two copies of a span choose the same starts. So no shared span of
``min_len`` is missed. An exact check follows: around each candidate unit all
windows of exactly ``min_len`` code points are digested and grouped again with
map-side partial aggregation, so a passage held by a third of all records
costs one pre-aggregated group and never a pair. Only candidate regions
reach that step. A code point is shared iff some window over it is shared,
which gives the coverage figures exactly, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import durable

BROADCAST_BYTES = 8 << 20  # most that the candidate regions may take to be broadcast
MIN_LEN = 240
UNIT = 100
GAP = 140
_GRAM = 8  # code points that decide a content-chosen start
_KIND = np.zeros(0x2030, np.uint8)  # 1 blank, 2 line end, 4 closing punctuation
_KIND[[0x20, 0xA0, 0x2002, 0x2007, 0x2009]] = 1
_KIND[10] = 2
_KIND[[ord(c) for c in ".!?:;"]] = 4
_BASE, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 4096  # code points of one field whose windows are held at once


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that the high bits depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _rolling(codes: np.ndarray, width: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Digest of every window of ``width`` code points, without overflow checks.

    Windows are combined by doubling, so the cost is log2(width) passes.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    have, h = 1, _mix(codes * base + np.uint64(1))
    parts: list[tuple[int, np.ndarray]] = []
    rest = width
    while True:
        if rest & 1:
            parts.append((have, h))
        rest >>= 1
        if not rest:
            break
        power = np.uint64(pow(int(base) | 1, have, 1 << 64))
        h = h[: len(h) - have] * power + h[have:]
        have *= 2
    out, at = np.zeros(n, np.uint64), 0
    for size, values in parts:
        power = np.uint64(pow(int(base) | 1, size, 1 << 64))
        out = out * power + values[at : at + n]
        at += size
    return _mix(out)


def _chosen(codes: np.ndarray, lo: int, hi: int) -> list[int]:
    """Content-chosen starts in [lo, hi): each window of GAP - _GRAM positions keeps its smallest digest.

    Ties go to the last position. Only windows inside the stretch count, so
    the choice never depends on where the stretch begins.
    """
    h = _rolling(codes[lo:hi].astype(np.uint64), _GRAM)
    w = GAP - _GRAM
    if len(h) < w:
        return []
    view = np.lib.stride_tricks.sliding_window_view(h[::-1], w) if len(h) <= 4096 else None
    if view is not None:
        keep = np.unique(len(h) - 1 - (np.arange(len(view)) + view.argmin(axis=1)))
        return [lo + int(p) for p in keep]
    out: set[int] = set()
    step = 4096 - w  # overlapping blocks see every window once
    for at in range(0, len(h) - w + 1, step):
        block = h[at : at + 4096]
        if len(block) < w:
            break
        r = np.lib.stride_tricks.sliding_window_view(block[::-1], w)
        out.update((at + len(block) - 1 - (np.arange(len(r)) + r.argmin(axis=1))).tolist())
    return [lo + p for p in sorted(out)]


def _hard_starts(codes: np.ndarray) -> np.ndarray:
    """Line starts, and sentence starts: a non-blank after one blank after closing punctuation."""
    if len(codes) < 3:
        return np.zeros(1, np.int64)
    kind = _KIND.take(codes, mode="clip")
    line = (kind[1:-1] == 2) & (kind[2:] != 2)
    sentence = (kind[:-2] == 4) & (kind[1:-1] == 1) & (kind[2:] != 1)
    return np.concatenate([np.zeros(1, np.int64), np.flatnonzero(line | sentence) + 2])


def unit_starts(codes: np.ndarray) -> np.ndarray:
    """Offsets of line, sentence and (in long stretches) content-chosen starts."""
    hard = _hard_starts(codes)
    ends = np.append(hard[1:], len(codes))
    soft = [p for a, b in zip(hard[ends - hard >= GAP], ends[ends - hard >= GAP]) for p in _chosen(codes, int(a), int(b))]
    return np.unique(np.concatenate([hard, np.asarray(soft, np.int64)])) if soft else hard


def _units(text: str) -> tuple[list[int], list[int], list[int | None]]:
    """Starts that have a whole unit behind them, the units' digests, and those of MIN_LEN code points from there."""
    raw = memoryview(text.encode("utf-32-le", "surrogatepass"))
    codes = np.frombuffer(raw, dtype=np.uint32)
    starts = unit_starts(codes)
    starts = starts[starts <= len(codes) - UNIT].tolist()
    digest, last = xxhash.xxh3_64_intdigest, len(codes) - MIN_LEN
    short = [digest(raw[4 * s : 4 * (s + UNIT)]) for s in starts]
    return starts, short, [digest(raw[4 * s : 4 * (s + MIN_LEN)]) if s <= last else 0 for s in starts]


def fields(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """One row per stored field value: ``id, field, text``; null and too short values have none."""
    parts = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("field"), F.col(c).alias("text")) for i, c in enumerate(text_cols)]))
    long = df.select(F.col(id_col).cast("long").alias("id"), parts.alias("f")).select("id", "f.field", "f.text")
    return long.filter(F.col("id").isNotNull() & (F.char_length("text") >= MIN_LEN))


def units(long: DataFrame) -> DataFrame:
    """``digest, id, field, start, whole``: one row per unit; ``whole`` digests MIN_LEN code points from the start, 0 where fewer are left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [_units(t) for t in b["text"]]
            n = [len(x[0]) for x in made]
            flat = lambda k, kind: np.fromiter((v for x in made for v in x[k]), kind, sum(n))
            yield pd.DataFrame({"digest": flat(1, "uint64").view("int64"), "id": np.repeat(b["id"].to_numpy(), n), "field": np.repeat(b["field"].to_numpy(), n).astype("int32"), "start": flat(0, "int32"), "whole": flat(2, "uint64").view("int64")})

    return long.select("id", "field", "text").mapInPandas(run, "digest long, id long, field int, start int, whole long")


def shared(rows: DataFrame, *key: str) -> DataFrame:
    """Keys held by two or more ids; a partial aggregate per map task keeps hot keys to one row each."""
    return rows.groupBy(*key).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select(*key)


def candidates(long: DataFrame) -> DataFrame:
    """The units that another id holds as well, cut from the lineage: all later steps start from these few rows.

    Grouping aggregates before its shuffle, and the join back leaves its own shuffle to adaptive skew
    splitting; so a unit that a third of all records hold burdens no single task. Both read the texts.
    """
    u = units(long)
    return durable(u.join(shared(u, "digest"), "digest", "left_semi"))


def regions(hits: DataFrame) -> DataFrame:
    """``id, field, starts, rank``: the candidate unit starts of one field value, bounded by that value's length."""
    return hits.groupBy("id", "field").agg(F.array_sort(F.collect_set("start")).alias("starts")).withColumn("rank", F.lit(0).cast("long"))


def _window_starts(n: int, starts: np.ndarray) -> np.ndarray:
    """First code points of all windows of MIN_LEN that hold one of the candidate units."""
    cover = np.zeros(n + 2, np.int32)
    a = np.maximum(0, starts + UNIT - MIN_LEN)
    b = np.minimum(starts, n - MIN_LEN)
    ok = a <= b
    np.add.at(cover, a[ok], 1)
    np.add.at(cover, b[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(cover)[:n] > 0)


def windows(long: DataFrame, where: DataFrame) -> DataFrame:
    """``digest, other, id, rank, field, at``: the exact windows over the given regions, with two independent digests of 64 bits.

    The regions are broadcast while they are few (at most ``BROADCAST_BYTES``); beyond that both sides are shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, f, t, s, r in zip(b["id"], b["field"], b["text"], b["starts"], b["rank"]):
                codes = _codes(t)
                at = _window_starts(len(codes), np.asarray(s, np.int64))
                if not len(at):
                    continue
                lo, hi = int(at[0]), int(at[-1]) + MIN_LEN
                d, o = (_rolling(codes[lo:hi], MIN_LEN, base)[at - lo].view(np.int64) for base in (_BASE, _OTHER))
                for k in range(0, len(at), 65536):  # a very long text leaves in pieces
                    m = min(65536, len(at) - k)
                    yield pd.DataFrame({"digest": d[k : k + m], "other": o[k : k + m], "id": np.full(m, i), "rank": np.full(m, r), "field": np.full(m, f, "int32"), "at": at[k : k + m].astype("int32")})

    where = durable(where)
    size = where.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("starts")), F.lit(0)).alias("s")).first()
    if size["n"] * 64 + size["s"] * 4 <= BROADCAST_BYTES:
        where = F.broadcast(where)
    return long.select("id", "field", "text").join(where, ["id", "field"]).mapInPandas(run, "digest long, other long, id long, rank long, field int, at int")


def found(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """Ids with a field value that holds a span of MIN_LEN code points found in another id too.

    Most records settle on units alone: a unit start followed by MIN_LEN code
    points that stand behind the same unit elsewhere. Windows are made only
    around units that some not yet settled record shares.
    Null, empty and shorter values hold no span; a row delivered twice is one
    record because only different ids count; an empty table gives no row.
    """
    long = fields(df, id_col, text_cols)
    hits = candidates(long)
    whole = hits.filter("whole != 0").select("digest", "whole", "id")
    settled = durable(whole.join(shared(whole, "digest", "whole"), ["digest", "whole"], "left_semi").select("id").distinct())
    open_units = hits.join(settled, "id", "left_anti").select("digest").distinct()
    w = durable(windows(long, regions(hits.join(open_units, "digest", "left_semi"))).select("digest", "other", "id").distinct())
    more = w.join(shared(w, "digest", "other"), ["digest", "other"], "left_semi").select("id")
    return settled.union(more).select(F.col("id").alias(id_col)).distinct()


def _intervals(at: np.ndarray) -> list[tuple[int, int]]:
    """``(begin, end)`` of the stretches that sorted windows cover."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > MIN_LEN) + 1
    return [(int(at[a]), int(at[z - 1]) + MIN_LEN) for a, z in zip([0, *cut], [*cut, len(at)])]


def _merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


_PARTS = "id long, field int, later boolean, begin int, end int"


def _stretches(df: DataFrame, id_col: str, text_cols: list[str], rank_col: str | None) -> DataFrame:
    """``id, field, begin, end, later``: maximal stretches all of whose windows occur in another id, and (``later``) those whose windows
    an earlier ranked id holds first.

    The windows of a field are put together by blocks of ``_BLOCK`` code points, so that
    no task holds one row per code point of a whole text.
    """
    long = fields(df, id_col, text_cols)
    where = regions(candidates(long)).drop("rank")
    if rank_col:
        # null ranks come last; a record delivered twice has the rank of its first delivery
        ranks = df.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.unix_micros(F.col(rank_col).cast("timestamp_ltz"))).alias("rank"))
        where = where.join(ranks, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(2**62)))
    else:
        where = where.withColumn("rank", F.lit(0).cast("long"))
    w = windows(long, where)
    key = ["digest", "other"]
    first = w.groupBy(*key).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min(F.struct("rank", "id")).alias("first")).filter("lo < hi").select(*key, F.col("first.id").alias("first_id"))
    hit = w.join(first, key).select("id", "field", F.floor(F.col("at") / _BLOCK).alias("block"), "at", (F.col("first_id") != F.col("id")).alias("later"))
    hit = hit.groupBy("id", "field", "block").agg(F.collect_set("at").alias("at"), F.collect_set(F.when(F.col("later"), F.col("at"))).alias("late"))

    def in_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, f, later, a, z) for i, f, every, late in zip(b["id"], b["field"], b["at"], b["late"]) for later, at in ((False, every), (True, late)) for a, z in _intervals(np.sort(np.asarray(at, np.int64)))]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _PARTS.split(", ")])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, f, later, a, z) for i, f, later, parts in zip(b["id"], b["field"], b["later"], b["parts"]) for a, z in _merged([(x["begin"], x["end"]) for x in parts])]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _PARTS.split(", ")])

    parts = hit.mapInPandas(in_block, _PARTS).groupBy("id", "field", "later").agg(F.collect_list(F.struct("begin", "end")).alias("parts"))
    return parts.mapInPandas(whole, _PARTS)


def _field_name(text_cols: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in text_cols]), F.col("field") + 1)


def spans(df: DataFrame, id_col: str, text_cols: list[str], rank_col: str | None = None) -> DataFrame:
    """Maximal shared spans with original offsets, and what deduplication removes.

    ``id, field_name, begin, end, removable``: code point offsets of a stretch all
    of whose windows occur elsewhere (``removable`` false), and of the stretches
    whose windows an earlier ranked record (rank, then id) holds first (``removable`` true).
    """
    return _stretches(df, id_col, text_cols, rank_col).select(F.col("id").alias(id_col), _field_name(text_cols).alias("field_name"), "begin", "end", F.col("later").alias("removable"))


def removed(df: DataFrame, id_col: str, text_cols: list[str], rank_col: str | None = None) -> DataFrame:
    """``id, field_name, text, removed_spans``: the field values from which later occurrences of shared spans were removed.

    Only values that lose something have rows; ``removed_spans`` keeps the original
    offsets, so that the rest can be located. The earliest ranked record keeps its
    text. Several different texts of one id and field are cut alike where
    they are long enough; equal rows give one.
    """
    cut = _stretches(df, id_col, text_cols, rank_col).filter("later").groupBy("id", "field").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("cut"))
    x = fields(df, id_col, text_cols).join(cut, ["id", "field"]).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, cut in zip(b["text"], b["cut"]):
                kept, at = [], 0
                for x in cut:
                    kept.append(t[at : x["begin"]])
                    at = x["end"]
                out.append("".join(kept) + t[at:])
            yield pd.DataFrame({"id": b["id"], "field": b["field"], "text": out, "cut": b["cut"]})

    got = x.mapInPandas(run, "id long, field int, text string, cut array<struct<begin:int, end:int>>")
    return got.select(F.col("id").alias(id_col), _field_name(text_cols).alias("field_name"), "text", F.col("cut").alias("removed_spans"))


def coverage(df: DataFrame, id_col: str, text_cols: list[str], rank_col: str | None = None) -> DataFrame:
    """Per record: code points held, shared with other records, and removable; records without text count 0."""
    total = df.groupBy(F.col(id_col).cast("long").alias(id_col)).agg(F.max(sum((F.coalesce(F.char_length(c), F.lit(0)) for c in text_cols), F.lit(0))).cast("long").alias("n_chars"))
    s = spans(df, id_col, text_cols, rank_col).groupBy(id_col).agg(F.sum(F.when(~F.col("removable"), F.col("end") - F.col("begin"))).alias("shared"), F.sum(F.when(F.col("removable"), F.col("end") - F.col("begin"))).alias("rem"))
    return total.join(s, id_col, "left").select(
        id_col,
        "n_chars",
        F.coalesce("shared", F.lit(0)).cast("long").alias("shared_chars"),
        F.coalesce("rem", F.lit(0)).cast("long").alias("removable_chars"),
        F.round(F.coalesce(F.col("shared") / F.when(F.col("n_chars") > 0, F.col("n_chars")), F.lit(0.0)), 6).alias("shared_share"),
    )
