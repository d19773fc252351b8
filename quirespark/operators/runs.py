"""Roll-ups over run logs and over results of repeated steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key: by ``order``, nulls oldest, equal rows once. Aggregates map-side, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.coalesce(F.col(order), F.lit("0001-01-01").cast("timestamp"))).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def roll_up(events: DataFrame, group: str, status: str, value: str, done: str) -> DataFrame:
    """``group, n, n_done, success_rate, total, average``: how many rows of a group are done and what they took."""
    n, ok = F.count("*"), F.count_if(F.coalesce(F.col(status) == done, F.lit(False)))
    return events.groupBy(group).agg(n.alias("n"), ok.alias("n_done"), F.round(ok / n, 6).alias("success_rate"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("average"))


def histogram(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def most_common(df: DataFrame, col: str) -> DataFrame:
    """One row: the value that occurs most; the first in order on a tie."""
    return histogram(df.filter(F.col(col).isNotNull()), col).agg(F.min_by(col, F.struct((-F.col("n")).alias("n"), col)).alias(col), F.max("n").alias("n"))


def percent(current: Column, total: Column, given: Column) -> Column:
    """Progress: a given percentage counts unless it is null or 0, else current over total."""
    return F.when(F.coalesce(given, F.lit(0)) != 0, given.cast("double")).when(total > 0, F.round(100.0 * current / total, 6)).otherwise(0.0)


def remaining(elapsed: Column, current: Column, total: Column) -> Column:
    return F.when(current > 0, F.round(elapsed / current * (total - current), 6))


def enhancement_summary(df: DataFrame) -> DataFrame:
    """``extraction_id, n, fixed, remaining, spelling, debris, words, characters, confidence``: sums over an extraction's enhancements; without any confidence it is 1."""
    s = "enhancement_summary"
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return df.groupBy("extraction_id").agg(
        F.count("*").alias("n"), z("issues_fixed").alias("fixed"), z("issues_remaining").alias("remaining"), z(f"{s}.spelling_corrections").alias("spelling"), z(f"{s}.debris_removed").alias("debris"),
        z(f"{s}.words_reconstructed").alias("words"), z(f"{s}.characters_fixed").alias("characters"), F.round(F.coalesce(F.avg("confidence"), F.lit(1.0)), 6).alias("confidence"),
    )


def drift(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``key, side, field``: fields that differ between two tables of one row per key, null equal to null; keys of one side only are named."""
    o = old.select(key, F.struct(*cols).alias("o"))
    n = new.select(key, F.struct(*cols).alias("n"))
    j = o.join(n, key, "full")
    side = F.when(F.col("n").isNull(), "old").when(F.col("o").isNull(), "new").otherwise("both")
    names = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in cols]))
    return j.select(key, side.alias("side"), F.explode(F.when(side == "both", names).otherwise(F.array(F.lit("*")))).alias("field"))


def versions(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``version``: 1 for the newest row of a key."""
    return df.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())))
