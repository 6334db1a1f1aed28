"""Folders for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short rows that are broadcast, at most (some MB).
FEW = 100_000


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share; one of this machine where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-warraq-")
    return f"{base}/warraq/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in a new folder, read from there: what comes after is computed from files."""
    path = fresh_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle.  Of a written table Spark knows the size of its compressed files, so without
    this it broadcasts what is exploded from them, through a driver that can't hold it."""
    return df.hint("merge")


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` (a written table of short rows), to be broadcast where it has no more than ``most`` rows, and else joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else shuffled(df)
