"""Narrators of a question against a plain loop, with many of one name."""

import random

from tests.test_similarity import most_rows
from warraq.operators import joins
from warraq.sources import folders


def asked(spark, questions, aliases, counts, **more):
    frame = spark.createDataFrame
    return joins.ground_mentions(frame(questions, "question_id long, text string"), frame(aliases, "narrator_id long, alias_norm string"), frame(counts, "narrator_id long, mentions long"), **more)


def plain(questions, aliases, counts, most=4, top=5):
    known, n, out = {}, dict(counts), set()
    for i, a in aliases:
        known.setdefault(a, set()).add(i)
    for q, text in questions:
        own = [w for w in (text or "").split(" ") if w]
        other = ["بن" if w == "ابن" else w for w in own]
        other = ["ابو", *other[1:]] if other and other[0] in ("ابا", "ابي") else other
        grams = {" ".join(x[i : i + k]) for x in (own, other) for k in range(1, most + 1) for i in range(len(x) - k + 1)}
        found = sorted({i for g in grams for i in known.get(g, ())}, key=lambda i: (-n.get(i, 0), i))
        out |= {(q, i, n.get(i, 0), rank) for rank, i in enumerate(found[:top], 1)}
    return out


def test_mentions_by_shared_names(spark, monkeypatch):
    r = random.Random(4)
    names = ["زيد", "عمر بن سعيد", "ابو بكر", "زيد بن علي", "سعيد", "علي"]
    aliases = [(i, r.choice(names)) for i in range(120) for _ in range(r.randint(1, 2))]
    counts = [(i, r.randint(1, 6)) for i in range(0, 120, 2)]
    questions = [(q, " ".join(r.choice([*names, "ابا بكر", "ابن", "عن", ""]) for _ in range(r.randint(0, 6)))) for q in range(60)] + [(99, None), (98, "ابا بكر عن عمر ابن سعيد")]
    want = plain(questions, aliases, counts)
    assert {tuple(x) for x in asked(spark, questions, aliases, counts).collect()} == want
    monkeypatch.setattr(joins, "few", lambda df: folders.few(df, 1))  # too many names to be broadcast
    assert {tuple(x) for x in asked(spark, questions, aliases, counts).collect()} == want


def test_namesakes_are_not_all_met(spark):
    """1000 questions after 3000 of one name: 3 million rows before, of which five a question were kept."""
    got = asked(spark, [(q, "حدثنا زيد") for q in range(1000)], [(i, "زيد") for i in range(3000)], [(7, 3)])
    assert {(x.narrator_id, x.rank) for x in got.collect()} == {(7, 1), (0, 2), (1, 3), (2, 4), (3, 5)}
    assert most_rows(got._jdf.queryExecution().executedPlan()) <= 5000
