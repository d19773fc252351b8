"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.

    A machine-local one is made only where the setting is absent and the session
    runs in a single process, as in tests. A cluster needs the setting: without
    it every later step would read and decode all texts again.
    """
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    if given.isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="quirespark-checkpoint-")
        sc.setCheckpointDir(where)
        given = sc._jsc.sc().getCheckpointDir()
    return given.get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared checkpoint folder.

    A written table is smaller than a checkpoint of rows, is read column by
    column, and its size is known to the planner, which broadcasts it only
    below its own threshold.
    """
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; looks at no more than one beyond."""
    return df.limit(rows + 1).count() <= rows


def blank(col: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return col.isNull() | ~col.rlike(r"\S")


def digest(col: Column) -> tuple[Column, Column]:
    """Two independent 64-bit digests; together they identify a text."""
    return F.xxhash64(col), F.xxhash64(F.lit("second"), col)
