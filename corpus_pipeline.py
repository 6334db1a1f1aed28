"""A corpus from raw documents in five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of documents, further ones included,
whatever their names.

Defined results: a null text counts as empty in every stage, and is scored, compared and packed like
an empty one; a null source or language is a category of its own; rows without id stay in the exact
stage as the copy of their text that has the least id, are never near copies, and share one draw a
cell.  Of rows equal in id and text one stays.  Ties of labels count as 0.  Empty tables give empty
results.  The near-copy stage keeps the smallest id of a component, the exact one the largest of
equal texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from warraq.llm import exact_dedup, mixture, packing, quality, shingle_join
from warraq.llm.common import ARROW_KEY, ARROW_ROWS, written

#: Where the session's own bound of batches is kept while the quality stage is written.
OWN_ROWS = "warraq.own.maxRecordsPerBatch"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Texts go to Python in the stage's own, later job, so the bound of its batches is the session's
    until the next stage begins, which puts back what the session had."""
    if spark.conf.get(OWN_ROWS, None) is None:
        spark.conf.set(OWN_ROWS, spark.conf.get(ARROW_KEY))
    spark.conf.set(ARROW_KEY, str(ARROW_ROWS))
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def own_batches(spark: SparkSession) -> None:
    """The bound of batches that the session had before the quality stage."""
    own = spark.conf.get(OWN_ROWS, None)
    if own is not None:
        spark.conf.set(ARROW_KEY, own)
        spark.conf.unset(OWN_ROWS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    own_batches(spark)
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id."""
    own_batches(spark)
    return shingle_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the source, language and topic targets."""
    own_batches(spark)
    return mixture.sampled(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in training sequences."""
    own_batches(spark)
    return packing.packed_sequences(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A fitted classifier and a packing are beyond SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
