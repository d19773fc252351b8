"""Problem 7: mixing sources to target weights.

Method: systematic sampling. Every document of a source is expected ``c``
times, where ``c`` is the source's share of the mixture over its own size. The
expected copies are prefix-summed within the source, one random offset is
added, and a document is emitted once per integer the sum crosses, so it
comes ``floor(c)`` or ``ceil(c)`` times and the source's total is exact to
within one copy.

The prefix sum is taken in three levels: ranks inside small slices of a source,
a running count over the slices of a block, and one over the blocks, so a source that holds a third of all
documents is spread over many tasks. Slices are ordered by hashed id; inside a
slice documents stand by token count, which keeps the tokens of the sample
close to their expectation.

Size. The mixture is ``total`` tokens; by default the largest total at which no
source needs more than ``max_repeats`` copies of itself, so all sources that have
documents reach their target in proportion. With a larger total, capped
sources stay below their target and the report shows it.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.llm.common import durable

SLICE = 2000  # documents of one slice, and slices of one block, about
MAX_PIECE = 100_000  # code points from which a text is tokenised in pieces, cut only where a single blank stands between two words


_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and pattern of the public tokenizer that sizes are measured by."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > MAX_PIECE:
        m = _BETWEEN.search(text, at + MAX_PIECE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def with_tokens(documents: DataFrame, text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``n_tokens`` of a public byte-level BPE vocabulary; null and empty texts have 0.

    ``vocabulary`` is the path of a tiktoken rank file, which is sent to the
    executors, and the pattern of its pre-tokenizer. Very long texts are
    encoded in pieces that end where that pattern splits as well.
    """
    path, pattern = vocabulary or default_vocabulary()
    name = os.path.basename(path)
    documents.sparkSession.sparkContext.addFile(path)
    cache: dict[str, object] = {}

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken
        from pyspark import SparkFiles

        if name not in cache:
            with open(SparkFiles.get(name), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            cache[name] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        enc = cache[name]
        for s in batches:
            yield pd.Series([0 if not t else sum(len(enc.encode_ordinary(p)) for p in _pieces(t)) for t in s], dtype="int64")

    return documents.withColumn("n_tokens", F.pandas_udf(count, "long")(F.col(text)))


def normal_source(col: str) -> F.Column:
    """Sources written in other case or with blanks around are the same source."""
    return F.nullif(F.lower(F.trim(F.col(col))), F.lit(""))


def sizes(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))


def plan(size: DataFrame, targets: DataFrame, total: float | None = None, fill: float = 1.0) -> DataFrame:
    """``source, target_share, max_repeats, n_documents, n_tokens, copies``: expected copies of each document of a source.

    One row per source of the target table; sources without documents (or
    only empty ones) get 0 copies. Targets are scaled to sum to 1 over them
    all; a null share counts 0 and a null cap 1. Without a ``total`` it is
    ``fill`` times the largest at which no cap binds.
    """
    t = targets.select(normal_source("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).filter("source IS NOT NULL")
    t = t.groupBy("source").agg(F.sum("share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    j = t.join(size, "source", "left").withColumn("have", F.coalesce("n_tokens", F.lit(0)))
    # one row per source: a small table whatever the corpus holds, so one window over all of it
    every = Window.partitionBy()
    j = j.withColumns({"sum": F.sum("share").over(every), "least": F.min(F.when((F.col("have") > 0) & (F.col("share") > 0), F.col("have") * F.col("max_repeats") / F.col("share"))).over(every)})
    want = F.lit(float(total)) * F.col("share") / F.col("sum") if total is not None else F.col("least") * F.col("share") * fill
    return j.select("source", F.round(F.col("share") / F.col("sum"), 6).alias("target_share"), "max_repeats", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.col("have").alias("n_tokens"), F.when(F.col("have") > 0, F.least(want / F.col("have"), F.col("max_repeats").cast("double"))).otherwise(0.0).alias("copies"))


def sample(tokens: DataFrame, p: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, source, n_tokens, copies``: whole copies of each document; documents with none are left out."""
    d = tokens.join(F.broadcast(p.select("source", F.col("copies").alias("c"), F.greatest(F.lit(1), F.ceil(F.col("n_documents") / SLICE)).alias("slices"))), "source").filter("c > 0")
    d = d.withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("slices")))
    counts = d.groupBy("source", "slice").agg(F.count("*").alias("n"))
    counts = counts.withColumn("block", F.floor(F.col("slice") / SLICE))
    prior = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = counts.withColumn("at", F.col("slice")).withColumn("inside", prior("source", "block")).drop("at", "n")
    # one row for about SLICE * SLICE documents of a source
    blocks = counts.groupBy("source", "block").agg(F.sum("n").alias("n")).withColumn("at", F.col("block")).withColumn("outside", prior("source")).drop("at", "n")
    before = inside.join(blocks, ["source", "block"]).select("source", "slice", (F.col("inside") + F.col("outside")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "slice").orderBy("n_tokens", "doc_id")) + F.col("before")
    u = F.pmod(F.xxhash64("source", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    d = d.join(before, ["source", "slice"]).withColumn("rank", rank)
    n = F.floor(F.col("rank") * F.col("c") + u) - F.floor((F.col("rank") - 1) * F.col("c") + u)
    return d.select("doc_id", "source", "n_tokens", n.cast("int").alias("copies")).filter("copies > 0")


def _tokens(documents: DataFrame, vocabulary: tuple[str, str] | None) -> DataFrame:
    d = documents.select("doc_id", normal_source("source").alias("source"), "text").filter("source IS NOT NULL")
    return durable(with_tokens(d, "text", vocabulary).select("doc_id", "source", "n_tokens"))


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: tuple[str, str] | None = None, seed: int = 7, fill: float = 1.0) -> DataFrame:
    """The mixture as ``doc_id, source, n_tokens, copies``. Documents without a source or of sources outside the targets take no part."""
    t = _tokens(documents, vocabulary)
    return sample(t, durable(plan(sizes(t), targets, total, fill)), seed)


def shares(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: tuple[str, str] | None = None, seed: int = 7, fill: float = 1.0) -> DataFrame:
    """One row per target source: what it holds, its repeats and the share of the mixture's tokens it reached."""
    t = _tokens(documents, vocabulary)
    p = durable(plan(sizes(t), targets, total, fill))
    got = sample(t, p, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed"), F.max("copies").alias("most"))
    return p.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "n_documents", "n_tokens",
        F.coalesce("mixed", F.lit(0)).alias("mixed_tokens"), F.coalesce("most", F.lit(0)).alias("most_copies"),
        F.round(F.coalesce(F.col("mixed") / F.sum("mixed").over(Window.partitionBy()), F.lit(0.0)), 6).alias("reached_share"),
    )
