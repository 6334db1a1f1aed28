"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic) cell, the cell weights are raked until the weighted
tokens meet the targets of all three margins, and each document is then sampled with probability
proportional to its cell's weight: the factor is solved so that the expected tokens are a given
share of all, and no probability exceeds 1.

The cell table has one row for each combination that occurs; its size is checked.  Up to MAX_CELLS
rows are raked by the driver, more of them as tables in Spark.  Both take the margins in the same
order and stop by the same rule (largest error of a margin below SETTLED, or ROUNDS), and both
report that error in the result.

Defined results: a null text has no tokens; a null source, language or topic is a category of its
own, ''; a category without tokens keeps weight 1; rows of equal id (also null) share their
decision within a cell; targets that no weights can meet (say, of a category that has no tokens)
leave the weights of the last round, and mix_error says by how much of all tokens the worst category
is off; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm.common import documents, text_of, written

MARGINS = ("source", "lang", "topic")
#: Target of a category: its share of tokens to this power, scaled to 1.  Below 1 flattens a margin.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Targets that ``op1_mixture`` states: half of the tokens are to be English; other languages share the rest.
TARGETS = {"lang": {"en": 0.5}}
#: Share of all tokens that a sample is to have.
SHARE = 0.7
MAX_CELLS, ROUNDS, SETTLED, SEED = 100_000, 200, 1e-9, 17
#: Forms of text, the first that is found: (topic, strings of which one must occur, a pattern that must then match).
FORMS = (
    ("table", (" | ", "\t"), None),
    ("symbols", ("###", "***", "$$$", "%%%", "&&&"), None),
    ("shouting", ("!!",), None),
    ("licence", ("icense", "icence", "ICENSE", "ICENCE", "opyright", "\u00a9"), None),
    ("contact", ("@",), r"[\w.+-]@[\w-]+\.[A-Za-z]"),
    ("web", ("://", "</"), None),
    ("code", ("();", ";\n", "{\n"), None),
    ("list", ("\n- ", "\n* ", "\n\u2022", "\n1. ", "\n1) "), None),
    ("dialogue", (": ", "\u2014 "), r"(?m)^(?:\u2014 |\p{Lu}\w{0,20}: )"),
    ("question", ("?",), None),
)
#: Words of prose by its length: less than each of these.
LENGTHS = (("note", 100), ("article", 1000))


def topic_of(text: Column, words: Column) -> Column:
    """The form of a text as its topic: the first of FORMS, else prose by its length."""
    out = F.when(words == 0, "empty")
    for name, strings, pattern in FORMS:
        found = reduce(or_, (text.contains(x) for x in strings))
        out = out.when(found & text.rlike(pattern) if pattern else found, name)
    for name, below in LENGTHS:
        out = out.when(words < below, name)
    return out.otherwise("long read")


def aims(names: list[str], tokens: np.ndarray, power: float, stated: dict[str, float] | None) -> tuple[np.ndarray, float]:
    """The target share of each category, and the share that is asked of categories without tokens.

    Stated categories get their shares; the others divide the rest by tokens ** power."""
    usual = np.where(tokens > 0, tokens.astype(float) ** power, 0.0)
    if not stated:
        return (usual / usual.sum() if usual.sum() else usual), 0.0
    named = np.array([n in stated for n in names], dtype=bool)
    out = np.array([stated.get(n, 0.0) for n in names], dtype=float)
    rest = usual * ~named
    if rest.sum():
        out += rest / rest.sum() * max(0.0, 1.0 - sum(stated.values()))
    lost = sum(v for k, v in stated.items() if k not in names) + float(out[tokens == 0].sum())
    return out / out.sum() if out.sum() else out, lost


def rake(tokens: np.ndarray, margins: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Cell weights whose weighted tokens have the target margins, and the largest error left.

    margins: for each margin the category number of each cell; targets: shares by category."""
    weight, total, error = np.ones(len(tokens)), tokens.sum(), 0.0
    for _ in range(rounds if total else 0):
        error = 0.0  # of each margin as it is met in the round: all are met once none is far off
        for of, target in zip(margins, targets):
            have = np.bincount(of, tokens * weight, len(target))
            error = max(error, float(np.abs(have / total - target).max()))
            weight *= np.divide(target * total, have, out=np.ones(len(target)), where=have > 0)[of]
        if error < SETTLED:
            break
    return weight, error


def next_factor(sure: float, open_: float, total: float, share: float) -> float:
    """The factor for which the tokens are right if the same cells stay at probability 1."""
    return (share * total - sure) / open_ if open_ > 0 else 0.0


def sampling_factor(sums, total: float, share: float) -> float:
    """f such that sum(tokens * min(1, f * weight)) is ``share`` of the tokens; sums(f): the tokens of
    cells with f * weight >= 1, and tokens * weight of the others.  Each step's factor is at least
    the one before, and more cells are at 1, so it ends; there are rarely ten steps."""
    sure, open_ = sums(0.0)
    factor = next_factor(sure, open_, total, share)
    while True:
        sure, open_ = sums(factor)
        if open_ <= 0 or share * total <= sure:
            return factor
        following = next_factor(sure, open_, total, share)
        if following <= factor * (1 + 1e-13):
            return factor
        factor = following


RAKED = "source string, lang string, topic string, weight double, probability double, error double"


def _cells_here(cells: DataFrame, flatten: dict, targets: dict, share: float) -> DataFrame:
    rows = cells.collect()  # their number is checked
    tokens = np.array([r["tokens"] for r in rows], dtype=float)
    margins, goals, lost = [], [], 0.0
    for m in MARGINS:
        names, of = np.unique([r[m] for r in rows], return_inverse=True)
        have = np.bincount(of, tokens, len(names)) if len(rows) else np.empty(0)
        goal, missed = aims([str(n) for n in names], have, flatten[m], targets.get(m))
        margins.append(of)
        goals.append(goal)
        lost = max(lost, missed)
    weight, error = rake(tokens, margins, goals)

    def sums(f):
        full = f * weight >= 1
        return float(tokens[full].sum()), float((tokens * weight)[~full].sum())

    factor = sampling_factor(sums, float(tokens.sum()), share)
    found = [(*(r[m] for m in MARGINS), float(w), float(min(1.0, factor * w)), max(error, lost)) for r, w in zip(rows, weight)]
    return cells.sparkSession.createDataFrame(found, RAKED)


def _aim_table(cells: DataFrame, m: str, power: float, stated: dict[str, float] | None) -> tuple[DataFrame, float]:
    """(m, aim) with shares by category, and the share asked of categories without tokens: ``aims`` as a table."""
    spark = cells.sparkSession
    have = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("have"))
    have = have.withColumn("usual", F.when(F.col("have") > 0, F.pow("have", F.lit(power))).otherwise(0.0))
    if not stated:
        whole = have.agg(F.sum("usual")).first()[0] or 1.0
        return written(have.select(m, (F.col("usual") / whole).alias("aim")), f"aim-{m}"), 0.0
    named = have.join(F.broadcast(spark.createDataFrame([*stated.items()], f"{m} string, stated double")), m, "left")
    rest = named.agg(F.sum(F.when(F.col("stated").isNull(), F.col("usual")))).first()[0] or 0.0
    left = max(0.0, 1.0 - sum(stated.values())) / rest if rest else 0.0
    table = written(named.select(m, "have", F.coalesce("stated", F.col("usual") * left).alias("aim")), f"aim-{m}")
    whole = table.agg(F.sum("aim")).first()[0]
    stated_met = table.join(F.broadcast(spark.createDataFrame([*stated.items()], f"{m} string, stated double")), m).where("have > 0").agg(F.sum("stated")).first()[0] or 0.0
    return table.select(m, (F.col("aim") / (whole or 1.0)).alias("aim")), sum(stated.values()) - stated_met


def _cells_apart(cells: DataFrame, flatten: dict, targets: dict, share: float) -> DataFrame:
    """The same on factor tables: each round scales one margin's factors after the other."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0.0)
    goals, lost = {}, 0.0
    for m in MARGINS:
        goals[m], missed = _aim_table(cells, m, flatten[m], targets.get(m))
        lost = max(lost, missed)
    weighted, error = written(cells.withColumn("weight", F.lit(1.0)), "cells"), 0.0
    for _ in range(ROUNDS if total else 0):
        error = 0.0
        for m in MARGINS:
            have = weighted.groupBy(m).agg(F.sum(F.col("tokens") * F.col("weight")).alias("have"))
            scale = written(goals[m].join(have, m).withColumn("scale", F.when(F.col("have") > 0, F.col("aim") * total / F.col("have")).otherwise(1.0)), f"scale-{m}")
            error = max(error, scale.agg(F.max(F.abs(F.col("have") / total - F.col("aim")))).first()[0])
            weighted = weighted.join(scale.select(m, "scale"), m).withColumn("weight", F.col("weight") * F.col("scale")).drop("scale")
        weighted = written(weighted, "cells")
        if error < SETTLED:
            break

    def sums(f):
        full = F.col("weight") * f >= 1
        got = weighted.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("tokens") * F.col("weight")))).first()
        return float(got[0] or 0), float(got[1] or 0)

    factor = sampling_factor(sums, total, share)
    chance = F.least(F.lit(1.0), F.col("weight") * factor)
    return weighted.select(*MARGINS, "weight", chance.alias("probability"), F.lit(float(max(error, lost))).alias("error"))


def mixture(docs: DataFrame, topic: Column | None = None, flatten: dict = FLATTEN, targets: dict | None = None, share: float = SHARE, seed: int = SEED, max_cells: int = MAX_CELLS) -> DataFrame:
    """A row for each row of ``docs``: the row itself as struct ``row``, doc_id, and mix_n_tokens,
    mix_source, mix_lang, mix_topic, mix_weight, mix_probability, mix_error and mix_sampled.

    ``topic``: a column of ``docs`` with the topic, instead of ``topic_of`` the text; ``targets``: for
    some of the margins the shares of some of their categories, the others divide the rest."""
    body = text_of()
    words = F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+"))
    category = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("row"),
        "doc_id",
        words.cast("long").alias("mix_n_tokens"),
        category(F.col("source")).alias("mix_source"),
        category(F.col("lang")).alias("mix_lang"),
        category(topic if topic is not None else topic_of(body, words)).alias("mix_topic"),
    )
    cells = written(rows.groupBy(*(F.col(f"mix_{m}").alias(m) for m in MARGINS)).agg(F.sum("mix_n_tokens").alias("tokens")), "cells")
    few = cells.limit(max_cells + 1).count() <= max_cells
    raked = (_cells_here if few else _cells_apart)(cells, flatten, targets or {}, share)
    raked = raked.withColumnsRenamed({c: f"mix_{c}" for c in (*MARGINS, "weight", "probability", "error")})
    out = rows.join(F.broadcast(raked) if few else raked, [f"mix_{m}" for m in MARGINS], "left")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 53)) / float(1 << 53)
    return out.withColumn("mix_sampled", draw < F.col("mix_probability"))


def sampled(docs: DataFrame, **how) -> DataFrame:
    """The documents of a sample, with the columns of ``docs``."""
    return mixture(docs, **how).where("mix_sampled").select("row.*")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(documents(spark, sf_dir), targets=TARGETS)
    return out.select("doc_id", *(F.col(f"mix_{c}").alias(c) for c in (*MARGINS, "n_tokens", "weight", "probability", "error", "sampled")))


QUERIES = {"op1_mixture": op1_mixture}
