"""Shards of near equal bytes by histogram sort.

Each text has a 52-bit key (a hash of its bytes), so equal texts share a key and no boundary can
part them.  Every round counts the exact bytes below 4096 candidate boundaries within each range
that still holds a splitter (partial sums before the shuffle, at most 7 * 4096 rows come back),
and refines only the ranges where no boundary is within the tolerance.  When all splitters are
settled, rows are exchanged once; a histogram of small cells of keys, summed up over each shard,
gives each cell its first slot, so rows go through no window larger than a cell.  A cell with very
many rows (one text copied often, with any ids) is dealt into sub-cells.

Defined results: a null text has no bytes and size 1; equal texts always share a shard, also where
one group is larger than a shard; an empty table gives an empty result; repeated rows have a slot each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warraq.llm.common import documents, text_of, written

KEY_BITS, ROUND_BITS = 52, 12
#: A splitter is settled when its bytes are within this share of all bytes from its target.
TOLERANCE = 0.0005
#: Rows of a cell that one task numbers, about.
CELL_ROWS = 20_000


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    body = text_of(text)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(body), 64 - KEY_BITS).alias("key"),
    )


def histogram_splitters(rows: DataFrame, n_shards: int, tolerance: float = TOLERANCE, weight: str = "size") -> tuple[list[int], int]:
    """Splitters (key boundaries, n_shards - 1 of them) and the number of counting rounds.

    Shard s takes keys from splitter s - 1 up to below splitter s.
    """
    open_ranges: dict[int, list[int]] = {0: list(range(1, n_shards))}  # first key of a range: targets in it
    below, best, total, depth, rounds = {0: 0}, {}, None, 0, 0
    while open_ranges:
        step = min(ROUND_BITS, KEY_BITS - depth)
        shift = KEY_BITS - depth - step
        within = rows if not depth else rows.where(F.shiftright("key", shift + step).isin([k >> (shift + step) for k in open_ranges]))
        counted = {r[0]: r[1] for r in within.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum(weight)).collect()}
        rounds += 1
        if total is None:
            total = sum(counted.values())
        following: dict[int, list[int]] = {}
        for first, targets in open_ranges.items():
            run, cells = below[first], sorted(c for c in counted if c >> step == first >> (shift + step))
            edges = [(first, run)]
            for c in cells:
                run += counted[c]
                edges.append(((c + 1) << shift, run))
            starts = {(c << shift): edges[i][1] for i, c in enumerate(cells)}
            for s in targets:
                aim = total * s / n_shards
                edge, error = min(((e, abs(b - aim)) for e, b in edges), key=lambda x: (x[1], x[0]))
                if s not in best or error < best[s][1]:
                    best[s] = (edge, error)
                if error > tolerance * total and shift:
                    cell = next((c << shift for i, c in enumerate(cells) if edges[i + 1][1] > aim), None)
                    if cell is not None:
                        below[cell] = starts[cell]
                        following.setdefault(cell, []).append(s)
        open_ranges, depth = following, depth + step
    edges = [best[s][0] for s in range(1, n_shards)]
    return [max(edges[: i + 1]) for i in range(len(edges))], rounds


def histogram_shards(docs: DataFrame, n_shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    rows = written(keyed(docs).withColumn("place", F.monotonically_increasing_id()), "keyed")
    splitters, _ = histogram_splitters(rows, n_shards, tolerance)
    shard = sum((F.when(F.col("key") >= s, 1).otherwise(0) for s in splitters), F.lit(0))
    n = rows.count()
    bits = min(16, max(1, (n // CELL_ROWS).bit_length() + 2))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("cell", F.shiftright("key", KEY_BITS - bits))
    # cells of keys: at most n_shards + 2**bits rows; those with very many rows are dealt into sub-cells
    cells = written(placed.groupBy("shard", "cell").agg(F.ceil(F.count("*") / CELL_ROWS).alias("parts")), "cells")
    placed = placed.join(F.broadcast(cells), ["shard", "cell"]).withColumn("sub", F.pmod(F.xxhash64("doc_id", "place"), F.col("parts")))
    counts = written(placed.groupBy("shard", "cell", "sub").agg(F.count("*").alias("k")), "counts")
    # first slots: sums over a shard's sub-cells, of which there is one for some thousands of rows
    before = Window.partitionBy("shard").orderBy("cell", "sub").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "cell", "sub", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "cell", "sub").orderBy("key", "doc_id", "size", "text_crc32", "place")
    ranked = placed.drop("parts").withColumn("rank", F.row_number().over(order))
    slot = F.col("first") + F.col("rank") - 1
    return ranked.join(first, ["shard", "cell", "sub"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(documents(spark, sf_dir))


QUERIES = {"op10_histogram_shards": op10_histogram_shards}
