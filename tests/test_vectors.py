"""Nearest vectors by cells and angles against all similarities."""

import numpy as np
import pytest

from warraq.operators import search


def nearest(corpus, queries, k):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    out = set()
    for q, v in queries:
        scored = sorted((-np.round(float(unit(v) @ unit(w)), 4), i) for i, w in corpus)[:k]
        out |= {(q, i, round(-s, 4), r + 1) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("k, part", [(3, 20), (50, 7), (5, 4096)])
def test_nearest_vectors(spark, k, part):
    """Clusters, a vector that a third of all rows have, zero vectors and nulls."""
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(8, 6))
    vectors = [(i, (centres[i % 8] + 0.05 * rng.normal(size=6)).tolist()) for i in range(240)]
    vectors += [(i, [1.0, 2.0, 0.0, 0.0, -1.0, 0.5]) for i in range(240, 360)] + [(360, [0.0] * 6), (361, [0.0] * 6)]
    queries = [*vectors[::11], (900, (-centres[0]).tolist()), (361, [0.0] * 6)]
    frame = lambda rows, name: spark.createDataFrame([*rows, (998, None), (999, [1.0, None, 0.0, 0.0, 0.0, 0.0])], f"{name} long, embedding array<double>").repartition(3)
    corpus, asked = frame(vectors, "vec_id"), frame(queries, "query_id")
    got = search.vector_knn(corpus, asked, k, part)
    assert {(r.query_id, r.vec_id, round(r.similarity, 4), r["rank"]) for r in got.collect()} == nearest(vectors, queries, k)
    if part == 20:
        _, met, every = search.knn_meetings(corpus, asked, k, part)
        assert met < every / 2


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert search.vector_knn(none, none.withColumnRenamed("vec_id", "query_id")).collect() == []
