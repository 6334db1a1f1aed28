"""Places and running sums in any order, without a window over a whole group.

Rows are dealt by ranges of (group, order), so a group with a third of all rows lies in many ranges.
Each task goes through its own rows; what a range hands on to the next (how many rows of a group
that goes on, and their sums) is one row a range, and only these go through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from warraq.sources.folders import fresh_folder

#: Columns that the scan adds for itself.
RANGE, AT, FIRST, TIE = "_range", "_at", "_first_run", "_tie"


def _unlike(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it (nulls are alike)."""
    before, after = column.slice(0, len(column) - 1), column.slice(1)
    differs = pc.fill_null(pc.not_equal(before, after), False)
    one_null = pc.not_equal(pc.is_null(before), pc.is_null(after))
    return pc.or_(differs, one_null).to_numpy(zero_copy_only=False)


def _local(keys: list[str], sums: list[str], schema: pa.Schema):
    """Batches of a sorted range with place, running sums, and what tells the range's first group."""

    def run(batches):
        part, at, first_run, held, carry, last = TaskContext.get().partitionId(), 0, True, 0, [0] * len(sums), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, dtype=bool)
            for k in keys:
                column = batch.column(k)
                starts[1:] |= _unlike(column)
                if last is not None:
                    starts[0] |= last[k] != column[0].as_py()
            own = np.flatnonzero(starts)  # where another group than that of the row before begins
            first_rows = np.zeros(n, dtype=bool)
            first_rows[: own[0] if len(own) else n] = first_run
            first_run = first_run and not len(own)
            index = np.arange(n)
            since = np.zeros(n, dtype=np.int64)
            since[own] = own
            since = np.maximum.accumulate(since)
            begun = np.cumsum(starts) > 0
            pos = np.where(begun, index - since + 1, index + 1 + held)
            out = [batch.column(i) for i in range(batch.num_columns)] + [pa.array(pos)]
            for j, s in enumerate(sums):
                total = np.cumsum(pc.fill_null(batch.column(s), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                before = np.concatenate([[0], total])[since]
                running = np.where(begun, total - before, total + carry[j])
                carry[j] = int(running[-1])
                out.append(pa.array(running))
            held = int(pos[-1])
            last = {k: batch.column(k)[n - 1].as_py() for k in keys}
            out += [pa.array(np.full(n, part, dtype=np.int32)), pa.array(at + index), pa.array(first_rows)]
            at += n
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, schema)], schema=schema)

    return run


def _handed_on(rows: DataFrame, keys: list[str], running: list[str]) -> list[tuple]:
    """(range, values that its first group has from the ranges before), for ranges that continue one."""
    whole = F.min(FIRST).alias("whole")
    ends = rows.groupBy(RANGE).agg(
        F.min_by(F.struct(*keys), AT).alias("head"), F.max_by(F.struct(*keys), AT).alias("tail"), F.max_by(F.struct(*running), AT).alias("values"), whole
    )
    out, tail, carried = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r[RANGE]):  # a row for each range
        goes_on = tail is not None and r.head == tail
        if goes_on:
            out.append((r[RANGE], *carried))
        tail = r.tail
        carried = [v + (c if goes_on and r.whole else 0) for v, c in zip(r["values"], carried or [0] * len(running))]
    return out


def in_ranges(df: DataFrame, by: list[Column | str]) -> DataFrame:
    """``df`` dealt by ranges of ``by`` and sorted within them; ties are in the order of reading."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn(TIE, F.monotonically_increasing_id()).repartitionByRange(parts, *by, TIE).sortWithinPartitions(*by, TIE).drop(TIE)


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], sums: list[str] = (), position: str = "pos") -> DataFrame:
    """``df`` with the place of each row (from 1) among those of its ``keys``, by ``order``, and with
    ``<name>_so_far``, the sum of each of ``sums`` up to and with the row (nulls count as 0).

    Without ``keys`` all rows are one group.  Ties come in the order of reading.  Nulls are a group
    like any other.  An empty table gives an empty result."""
    spark, sums = df.sparkSession, list(sums)
    dealt = in_ranges(df, [*keys, *order])
    running = [position, *(f"{s}_so_far" for s in sums)]
    added = [*(StructField(c, LongType()) for c in running), StructField(RANGE, IntegerType()), StructField(AT, LongType()), StructField(FIRST, BooleanType())]
    schema = StructType([*dealt.schema.fields, *added])
    from pyspark.sql.pandas.types import to_arrow_schema

    path = fresh_folder(spark, "numbered")
    dealt.mapInArrow(_local(list(keys), sums, to_arrow_schema(schema)), schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    handed = _handed_on(rows, list(keys) or [F.lit(0).alias("all")], running)
    if handed:
        more = spark.createDataFrame(handed, f"{RANGE} int, " + ", ".join(f"_more_{c} long" for c in running))
        rows = rows.join(F.broadcast(more.withColumn(FIRST, F.lit(True))), [RANGE, FIRST], "left")
        for c in running:
            rows = rows.withColumn(c, F.col(c) + F.coalesce(f"_more_{c}", F.lit(0)))
    return rows.select(*df.columns, *running)


def neighbours(df: DataFrame, keys: list[str], order: list[Column | str], of: str) -> DataFrame:
    """``df`` with prev_id and next_id, the value of ``of`` in the rows before and after each row of its
    ``keys`` (not null) by ``order``: places are numbered by ranges and met by (keys, place), of which
    no two rows have the same."""
    rows = numbered(df, keys, order, position="_place")
    at = lambda name, shift: rows.select(*keys, (F.col("_place") + shift).alias("_place"), F.col(of).alias(name))
    by = [*keys, "_place"]
    return rows.join(at("prev_id", 1), by, "left").join(at("next_id", -1), by, "left").select(*df.columns, "prev_id", "next_id")
