"""What plans must not do, however small a table looks."""

import pytest

from tests.oracle import SF
from warraq.bindings import Tables
from warraq.operators import joins


@pytest.fixture
def generous(spark):
    """Every table looks small enough to be broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    own = spark.conf.get(key)
    spark.conf.set(key, str(1 << 40))
    yield
    spark.conf.set(key, own)


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_texts_are_not_broadcast(spark, generous):
    """Tokens exploded from a small file went through the driver."""
    texts = [(i, " ".join(f"w{i // 2 * 7 + k}" for k in range(20)) + " end" * (i % 2)) for i in range(40)]
    new = spark.createDataFrame(texts[::2], "passage_id long, text_norm string")
    corpus = spark.createDataFrame(texts[1:20:2], "passage_id long, text_norm string").select("text_norm")
    mapped = spark.createDataFrame([(38,)], "passage_id long")
    left = joins.near_duplicate_gate(new, corpus, mapped)
    assert {r.passage_id for r in left.collect()} == set(range(20, 38, 2))
    assert "BroadcastHashJoin" not in plan_of(left)


def test_keys_of_chains_are_not_broadcast(spark, generous):
    assert "BroadcastHashJoin" not in plan_of(Tables(spark, SF).chains)
