"""Upserts, ledgers and mirrored tables as joins of the old and the new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows win."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def upsert_guarded(old: DataFrame, new: DataFrame, keys: list[str], protected: list[str]) -> DataFrame:
    """New rows win, but not over rows from a protected source."""
    rank = F.when(F.col("_old") & F.col("source").isin(protected), 0).when(~F.col("_old"), 1).otherwise(2)
    every = old.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)))
    first = Window.partitionBy(*keys).orderBy(rank)
    return every.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_old", "_rn")


def not_done(rows: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(ledger.where("status = 'done'").select(*keys), keys, "left_anti")


def changed(rows: DataFrame, ledger: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    """Rows whose content hash is new or differs from the ledger's; all of them with ``overwrite``."""
    if overwrite:
        return rows
    known = ledger.select(*keys, F.col("content_hash").alias("_known"))
    return rows.join(known, keys, "left").where(~F.col("content_hash").eqNullSafe(F.col("_known"))).drop("_known")


def mirror_actions(target: DataFrame, staged: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What makes ``target`` equal to ``staged``: keys with insert, update, delete or keep."""
    a = target.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = staged.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    action = F.when(F.col("_in_a").isNull(), "insert").when(F.col("_in_b").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update").otherwise("keep")
    return a.join(b, keys, "full_outer").select(*keys, action.alias("action"))


def replace_by_edition(df: DataFrame, path: str) -> None:
    """The editions of ``df`` replace their own partitions of the table at ``path``; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("edition_id").parquet(path)


def mapped_by_natural_key(staged: DataFrame, editions: DataFrame, passages: DataFrame) -> DataFrame:
    """Staged rows (source, source_book_id, seq, ...) with the passage_id that this corpus has for them;
    rows without one are left out."""
    books = editions.select("source", "source_book_id", "edition_id")
    places = passages.select("edition_id", "seq", "passage_id")
    found = staged.join(books, ["source", "source_book_id"]).join(places, ["edition_id", "seq"])
    return found.select("passage_id", *staged.columns)


def mapping_counts(staged: DataFrame, mapped: DataFrame) -> DataFrame:
    """One row: staged, mapped, and skipped, the staged rows that have no passage here."""
    both = staged.agg(F.count("*").alias("staged")).crossJoin(mapped.agg(F.count("*").alias("mapped")))  # a row each
    return both.withColumn("skipped", F.col("staged") - F.col("mapped"))
