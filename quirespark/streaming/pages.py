"""Pages that arrive one after the other: book state carried from batch to batch (an extension of the batch operators)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_books(pages: DataFrame, key: str = "book_key", page: str = "page_no", text: str = "text") -> DataFrame:
    """``key, pages, chars, last_page`` of each book after each batch; the state is three numbers a book, however long it grows."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, chars, last = state.get if state.exists else (0, 0, 0)
        for b in batches:
            n += len(b)
            chars += int(b["n"].sum())
            last = max(last, int(b["p"].max()))
        state.update((n, chars, last))
        yield pd.DataFrame({"k": [k[0]], "pages": [n], "chars": [chars], "last_page": [last]})

    x = pages.select(F.coalesce(F.col(key), F.lit("")).alias("k"), F.coalesce(F.col(page), F.lit(0)).cast("long").alias("p"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n"))
    return x.groupBy("k").applyInPandasWithState(step, "k string, pages long, chars long, last_page long", "pages long, chars long, last long", "update", GroupStateTimeout.NoTimeout).withColumnRenamed("k", key)


def windowed_events(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per kind and window; rows later than ``late`` behind the newest are left out by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
