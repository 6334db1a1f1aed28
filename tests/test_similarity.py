"""Trigram similarity against a plain loop, with many copies of few texts."""

import random
import re

from warraq.operators import search


def grams(text):
    words = [f"  {w} " for w in re.split(r"\W+", (text or "").lower()) if w]
    return {w[i : i + 3] for w in words for i in range(len(w) - 2)}


def plain(a, b, least=0.55, top=3):
    out = set()
    for i, x in a:
        g = grams(x)
        near = [(round(len(g & grams(y)) / len(g), 4), j) for j, y in b] if g else []
        out |= {(i, j, s) for s, j in sorted((p for p in near if p[0] > least), key=lambda p: (-p[0], p[1]))[:top]}
    return out


def test_trigram_similarity_of_copies_and_forms(spark):
    r = random.Random(3)
    words = ["red", "reed", "gear", "gears", "small", "smaller", "ring", "widget", "rings"]
    made = lambda n, at: [(at + i, r.choice([" ", "-"]).join(r.choice([w, w.upper()]) for w in r.sample(words, r.randint(1, 3)))) for i in range(n)]
    a, b = made(60, 0) + [(900, None), (901, ""), (902, "--"), (903, "zzz")], made(150, 5000) + [(1, None), (2, "")]
    r.shuffle(b)
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = search.trigram_word_similarity(frame(a, "a_id"), frame(b, "b_id"))
    assert {tuple(x) for x in got.collect()} == plain(a, b)


def most_rows(node) -> int:
    """The most rows that an operator of an executed plan made."""
    name = node.getClass().getSimpleName()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    own = node.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, inner)])


def test_copies_are_not_paired(spark):
    """4000 rows of two texts after 4000: 8 million pairs before, of which three a row were kept."""
    rows = spark.range(4000).selectExpr("id as a_id", "if(id % 2 = 0, 'small red gear', 'old ring') as text")
    got = search.trigram_word_similarity(rows, rows.withColumnRenamed("a_id", "b_id"))
    found = got.collect()
    assert len(found) == 12_000 and {(x.a_id % 2, x.b_id) for x in found} == {(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5)}
    assert most_rows(got._jdf.queryExecution().executedPlan()) == 12_000
