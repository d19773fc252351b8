"""Problem 6: evaluation texts leaking into training text.

Method: prefix-filtered set join. An item leaks through a window of ``WINDOW``
consecutive words. Each window is the set of its five-word shingles; shingles
are ordered by rarity in the corpus, and since containment must be complete,
the rarest one alone is a necessary prefix token of the window. Documents join
on prefix tokens only; the position of the token inside the window bounds where
the window can lie, and the exact check compares all ``WINDOW`` words there.

The documents are read by one pass. A document can only match where all shingles
of a window are shingles of items, so the pass keeps the stretches of at least
so many consecutive item shingles with their words (length bound), and counts
all item shingles for their rarity; everything after works on these stretches.

Words are unbroken runs of letters and digits in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import durable, small

WINDOW = 13
SHINGLE = 5
BROADCAST_ROWS = 200_000  # shingles of items that are sent to every task (8 bytes each); more are joined by a shuffle

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _shingles(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts, one behind the other: the digest of the shingle that begins there, whether it lies inside its text, and the text's number."""
    known: dict[str, int] = {}
    flat = [w for t in texts for w in t]
    for w in flat:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    h = np.fromiter((known[w] for w in flat), np.uint64, len(flat))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    g = np.zeros(len(flat), np.uint64)
    n = max(0, len(flat) - SHINGLE + 1)
    for k in range(SHINGLE):
        g[:n] = g[:n] * _BASE + h[k : k + n]
    return (g ^ (g >> np.uint64(31))).view(np.int64), left >= SHINGLE, owner


def _stretches(hit: np.ndarray) -> list[tuple[int, int]]:
    """``(begin, end)`` of runs of hits that are long enough to hold a window."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [(int(a), int(z)) for a, z in zip(edge[::2], edge[1::2]) if z - a > WINDOW - SHINGLE]


_RUNS = "gram long, n long, doc_id long, pos int, grams array<long>, words array<string>"


def _batch(ids: list, texts: list[str], wanted: list[np.ndarray] | np.ndarray) -> pd.DataFrame:
    """Counts of the wanted shingles (``gram, n``) and the stretches of one batch; ``wanted`` is sorted, one for all texts or one for each."""
    w = [words(t) for t in texts]
    g, inside, owner = _shingles(w)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in w])])
    if isinstance(wanted, np.ndarray):
        at = np.minimum(np.searchsorted(wanted, g), max(0, len(wanted) - 1))
        hit = inside & (wanted[at] == g) if len(wanted) else np.zeros(len(g), bool)
    else:
        hit = inside & np.concatenate([np.isin(g[a:z], x) for a, z, x in zip(begin, begin[1:], wanted)] or [np.zeros(0, bool)])
    rows = [(int(x), int(n), None, 0, [], []) for x, n in zip(*np.unique(g[hit], return_counts=True))]
    for a, z in _stretches(hit):
        d = int(owner[a])
        p = a - int(begin[d])
        rows.append((None, 0, ids[d], p, g[a:z].tolist(), w[d][p : p + z - a + SHINGLE - 1]))
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in _RUNS.split(", ")])
    out["gram"] = pd.array([r[0] for r in rows], "Int64")
    out["doc_id"] = pd.array([r[2] for r in rows], "Int64")
    return out


def _runs(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """Counts and stretches of all documents, cut from the lineage."""
    if small(grams, BROADCAST_ROWS):
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in grams.collect()], np.int64)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield _batch(b["doc_id"].tolist(), b["text"].tolist(), shared.value)

        return durable(docs.mapInPandas(run, _RUNS))

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g, inside, owner = _shingles([words(t) for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[owner[inside]], "gram": g[inside]}).drop_duplicates()

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _batch(b["doc_id"].tolist(), b["text"].tolist(), [np.asarray(x, np.int64) for x in b["wanted"]])

    # digests alone are shuffled; of each document only those that it shares with an item come back to it
    shared = docs.mapInPandas(every, "doc_id long, gram long").join(grams, "gram", "left_semi").groupBy("doc_id").agg(F.collect_set("gram").alias("wanted"))
    return durable(docs.join(shared, "doc_id").select("doc_id", "text", "wanted").mapInPandas(some, _RUNS))


def matches(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, doc_pos, item_pos``: every shared window, word positions counted from 0.

    Null and empty texts and texts of fewer than ``WINDOW`` words match
    nothing; repeated rows of one id give their windows once, and an id with
    several texts gives the windows of each.
    """
    return _matches(documents, _texts(items, item_id, text), doc_id, text).select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "doc_pos", "item_pos").distinct()


def _texts(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item_id, t, w, g``: the different texts of each item, told apart by the digest t of their words, with their shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = [words(t) for t in b["text"]]
            g, inside, owner = _shingles(w)
            yield pd.DataFrame({"item_id": b["item_id"], "w": w, "g": [g[inside & (owner == k)].tolist() for k in range(len(w))]})

    its = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    its = its.mapInPandas(run, "item_id long, w array<string>, g array<long>")
    return durable(its.select("item_id", F.xxhash64("w").alias("t"), "w", "g").dropDuplicates(["item_id", "t"]))


def _matches(documents: DataFrame, its: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, item_id, t, doc_pos, item_pos``; item positions count within the text t."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL AND text != ''")
    its = its.filter(F.size("w") >= WINDOW)
    item_grams = its.select("item_id", "t", F.posexplode("g").alias("pos", "gram"))
    both = _runs(docs, durable(item_grams.select("gram").distinct()))
    rarity = both.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n"))

    # each window's rarest shingle; windows with an unseen shingle cannot occur
    inside = item_grams.join(rarity, "gram")
    slots = inside.select("item_id", "t", "gram", "n", F.explode(F.expr(f"transform(sequence(0, {WINDOW - SHINGLE}), k -> struct(pos - k AS item_pos, k AS off))")).alias("s")).select("item_id", "t", "gram", "n", "s.item_pos", "s.off")
    rare = slots.groupBy("item_id", "t", "item_pos").agg(F.min(F.struct("n", "gram", "off")).alias("r"), F.count("*").alias("have")).filter(f"have = {WINDOW - SHINGLE + 1}")
    window = lambda at: F.array_join(F.slice("w", at + 1, WINDOW), " ")
    whole = its.select("item_id", "t", "w", F.explode(F.expr(f"sequence(0, size(w) - {WINDOW})")).alias("item_pos")).select("item_id", "t", "item_pos", window(F.col("item_pos")).alias("full"))
    tokens = durable(rare.join(whole, ["item_id", "t", "item_pos"]).select(F.col("r.gram").alias("gram"), F.col("r.off").alias("off"), "full", "item_id", "t", "item_pos"))

    # equal windows of several items travel once
    runs = both.filter("gram IS NULL").select("doc_id", "pos", F.col("words").alias("w"), F.posexplode("grams").alias("k", "gram"))
    near = runs.join(tokens.select("gram", "off", "full").distinct(), "gram").withColumn("at", F.col("k") - F.col("off")).filter(f"at >= 0 AND at + {WINDOW} <= size(w)")
    exact = near.filter(window(F.col("at")) == F.col("full")).select("doc_id", (F.col("pos") + F.col("at")).alias("doc_pos"), "full").distinct()
    return exact.join(tokens.select("full", "item_id", "t", "item_pos"), "full").select("doc_id", "item_id", "t", "doc_pos", "item_pos")


def found(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Documents and the items of which they hold ``WINDOW`` consecutive words."""
    return matches(documents, items, doc_id, item_id, text).select(doc_id, item_id).distinct()


def report(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Per item: documents that leak it, shared windows, and the share of its words that leaked somewhere; items without a leak count 0.

    Where an id has several texts, words and windows of all of them count.
    """
    its = _texts(items, item_id, text)
    m = durable(_matches(documents, its, doc_id, text))
    total = its.groupBy("item_id").agg(F.sum(F.size("w")).cast("long").alias("n_words"))
    hit = m.groupBy("item_id").agg(F.countDistinct("doc_id").alias("d"), F.countDistinct("t", "item_pos").alias("k"))
    covered = m.select("item_id", "t", F.explode(F.expr(f"sequence(item_pos, item_pos + {WINDOW - 1})")).alias("p")).groupBy("item_id").agg(F.countDistinct("t", "p").alias("c"))
    return total.join(hit, "item_id", "left").join(covered, "item_id", "left").select(
        F.col("item_id").alias(item_id),
        "n_words",
        F.coalesce("d", F.lit(0)).cast("long").alias("n_documents"),
        F.coalesce("k", F.lit(0)).cast("long").alias("n_windows"),
        F.round(F.coalesce(F.col("c") / F.when(F.col("n_words") > 0, F.col("n_words")), F.lit(0.0)), 6).alias("leaked_share"),
    )
