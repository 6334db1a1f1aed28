"""Arrow-batched helpers that a worker may import without a session, and columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vectorized(returns: str):
    """Like ``pandas_udf``, but made when it is applied to columns."""
    return lambda f: lambda *columns: F.pandas_udf(f, returns)(*columns)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once a row: a generator stands between them and what uses
    them, so that the optimiser doesn't put the expression in the place of each use."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
