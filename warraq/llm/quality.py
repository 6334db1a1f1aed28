"""Quality scores by regularised quadratic discriminant analysis.

Each document is reduced to transformed statistics of its text; the two classes' means and
covariances are summed where the labelled rows lie (one small moment matrix a task), shrunk
towards the pooled covariance and its diagonal, and factored once.  A score is the sigmoid of the
difference of the Gaussian log-densities, each from one triangular solve with the cached factor.

Defined results: a null or empty text has the statistics of an empty one and is scored like any;
rows without label or id are scored and never learnt from; where labels of an id disagree the
majority counts, a tie as 0; without two classes of labels every score is the share of 1s seen
(0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm.common import documents, give_back, released, remainder, small_batches, text_of, thinned, written

#: Weight of the pooled covariance, and then of its diagonal, in a class's own.
POOLED, DIAGONAL = 0.1, 0.05
#: Scores from here on are predicted 1.
THRESHOLD = 0.7
STATISTICS = ("length", "word_length", "word_spread", "upper", "digits", "symbols", "marks", "stops", "distinct_words", "commonest", "distinct_lines", "line_length", "symbol_words", "runs", "other_letters", "echoes")
D = len(STATISTICS)

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#$%&*@|<>{}[]=~^_\\+/`", dtype=np.uint8))
_CLASS = np.full(256, 6, dtype=np.uint8)  # 0 upper, 1 lower, 2 digit, 3 symbol, 4 stop, 5 mark, 6 other, 7 white, 8 not ASCII
for _i, _of in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*@|<>{}[]=~^_\\+/`", b".,;:", b"!?", b"", b" \t\n\x0b\x0c\r")):
    _CLASS[list(_of)] = _i
_CLASS[128:] = 8


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text (logarithms of shares, so that junk is far in the tail but finite)."""
    raw = text.encode()
    n = len(raw)
    units = np.frombuffer(raw, dtype=np.uint8)
    kinds = _CLASS[units]
    upper, lower, digits, symbols, stops, marks, _, white, other = np.bincount(kinds, minlength=9).tolist()
    words = raw.split()
    m = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=m)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    tally = Counter(words)
    common = tally.most_common(1)[0][1] if m else 0
    ending = sum(_SYMBOLS[w[-1]] for w in tally) / len(tally) if m else 0.0
    same = int(np.count_nonzero(units[1:][(units[1:] == units[:-1]) & (kinds[1:] != 7)])) if n > 1 else 0
    share = lambda a, b, least=1e-3: math.log((a + least) / (b + least)) if b else math.log(least)
    return [
        math.log1p(m),
        math.log1p(float(lengths.mean())) if m else 0.0,
        math.log1p(float(lengths.std())) if m else 0.0,
        share(upper / n if n else 0, 1, 1e-2),
        share(digits / n if n else 0, 1),
        share(symbols / n if n else 0, 1),
        share(marks / n if n else 0, 1),
        share(stops / n if n else 0, 1, 1e-2),
        math.log(len(tally) + 1) - math.log1p(m) * 0.85,
        share(common / m if m else 0, 1, 1e-2),
        share(len(set(lines)) / len(lines), 1) if lines else 0.0,
        math.log1p(n / len(lines)) if lines else 0.0,
        share(ending, 1, 1e-2),
        share(same / n if n else 0, 1, 1e-2),
        share(other / n if n else 0, 1, 1e-2),
        share(sum(map(eq, words, words[1:])) / m if m else 0, 1, 1e-2),
    ]


def _measured(batches):
    for batch in batches:
        found = [statistics(t) for t in batch.column(1).to_pylist()]
        flat = pa.array(np.asarray(found, dtype=np.float64).ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) * D + 1, D), pa.int32()), flat)], names=["doc_id", "x"])


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("body"))
    return rows.mapInArrow(released(_measured), "doc_id long, x array<double>")


def _moments(batches):
    """Count, sums and sums of products of each class: one row of each class a task."""
    sums = {}
    for batch in batches:
        of = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
        x = np.hstack([np.ones((len(x), 1)), x])
        for c in np.unique(of):
            own = x[of == c]
            sums[int(c)] = sums.get(int(c), 0) + own.T @ own
    for c, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([s.ravel().tolist()])], names=["class", "products"])


def solved(factor: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows z with factor @ z = y, by forward substitution over all rows at once."""
    z = np.empty_like(y)
    for i in range(len(factor)):
        z[:, i] = (y[:, i] - z[:, :i] @ factor[i, :i]) / factor[i, i]
    return z


class Discriminant:
    """Two Gaussians with shrunk covariances; holds their Cholesky factors."""

    def __init__(self, products: dict[int, np.ndarray], pooled: float = POOLED, diagonal: float = DIAGONAL):
        counts = {c: p[0, 0] for c, p in products.items()}
        total = sum(counts.values())
        self.constant = None if len(products) == 2 else (counts.get(1, 0) / total if total else 0.5)
        self.parts = []
        if self.constant is not None:
            return
        means = {c: p[0, 1:] / p[0, 0] for c, p in products.items()}
        scatter = {c: p[1:, 1:] - p[0, 0] * np.outer(means[c], means[c]) for c, p in products.items()}
        common = sum(scatter.values()) / total
        for c in (0, 1):
            own = (1 - pooled) * scatter[c] / counts[c] + pooled * common
            own = (1 - diagonal) * own + diagonal * np.diag(np.diag(common)) + 1e-6 * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            # log density but for a constant: log prior - log det / 2 - distance / 2
            self.parts.append((means[c], factor, math.log(counts[c] / total) - float(np.log(np.diag(factor)).sum())))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [level - 0.5 * (solved(factor, x - mean) ** 2).sum(axis=1) for mean, factor, level in self.parts]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fitted(x: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """The discriminant of rows (doc_id, x) by ``labels`` (doc_id, label); every labelled row counts."""
    votes = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    votes = votes.agg((F.avg(F.col(label).cast("double")) > 0.5).cast("int").alias("class"))
    sums = x.join(votes, "doc_id").select("class", "x").mapInArrow(released(_moments), "class int, products array<double>")
    # summed in Spark: (D + 1)**2 numbers of each class come back
    total = sums.select("class", F.posexplode("products")).groupBy("class", "pos").agg(F.sum("col").alias("s")).collect()
    products = {}
    for r in total:
        products.setdefault(r["class"], np.zeros((D + 1) ** 2))[r["pos"]] = r["s"]
    return Discriminant({c: p.reshape(D + 1, D + 1) for c, p in products.items()})


def scored(x: DataFrame, model: Discriminant) -> DataFrame:
    """Rows (doc_id, x) with ``score``."""

    def run(batches):
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(rows))], names=["doc_id", "score"])

    return x.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from: the rest is held out."""
    return labels.where(remainder("doc_id", 4) != 2)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, score, predicted."""
    with small_batches(docs.sparkSession):
        x = written(measured(docs), "statistics")
    out = scored(x, fitted(x, learnable(labels)))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, with all their columns.

    Texts are scored where they lie, in Arrow batches of the session's bound."""
    own = F.xxhash64(F.col("doc_id").cast("long"))
    known = learnable(labels).where("doc_id is not null").select(own.alias("h"))
    with small_batches(docs.sparkSession):
        # the filter leaves hardly any row without a label, and the join with the labels is exact
        x = written(measured(thinned(docs.select("doc_id", "text"), own, known)), "statistics")
    model = fitted(x, learnable(labels))
    kept = F.pandas_udf(lambda bodies: _predicted(bodies, model, threshold), "boolean")
    return docs.where(kept(text_of()))


def _predicted(bodies, model, threshold):
    import pandas as pd

    rows = np.asarray([statistics(t) for t in bodies], dtype=np.float64).reshape(-1, D)
    give_back()
    return pd.Series(model.scores(rows) >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op7_quality": op7_quality}
