"""Rules from tables against a plain search of each pattern in turn."""

import random
import re

import pytest
from pyspark.sql import functions as F

from warraq.operators import analytics, rules
from warraq.operators import rule_table as R


def plain(patterns, text):
    return next((i for i, p in enumerate(patterns) if re.search(p, text)), None) if text is not None else None


TABLES = {
    "overlaps": ["abc", "bcd(e|f)", "ab", "b", "cd$"],
    "optional": ["xy?z", "colou?r", "(ab)?cd", "e+f", "gh*i"],
    "open": ["a[bc]d", "x.z", r"\d+", "(ab|)c", "^$"],
    "signs": [r"ab\sc", "^ab", "a (b|c) d|e f"],
    "mixed": ["zz|[xy]w", "q", "(?:ab|ba)c|cab"],
}


@pytest.mark.parametrize("name", TABLES)
def test_the_first_rule_that_holds(spark, name):
    rng, patterns = random.Random(name), TABLES[name]
    texts = ["".join(rng.choice("abcdefghixyzwq rlou1" if k % 2 else "abc def") for _ in range(rng.randrange(14))) for k in range(400)]
    texts += ["", None, "colour", "color", "xz", "xyz", "abcd", "abcde", "ab c", "a b d", "bcdf"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.x for r in rows.select("i", R.first_that_holds(F.col("t"), patterns, F.lit).alias("x")).collect()}
    assert got == {i: plain(patterns, t) for i, t in enumerate(texts)}


def test_strings_of_patterns():
    assert R.literals("(يوم|عام) بدر|ببدر") == ["ببدر", "بدر"]
    assert R.literals("xy?z") == ["x"] and R.literals("a[bc]") == ["a"] and R.literals("(ab|)c") == ["c"] and R.literals("a|(b|c)") == ["a", "b", "c"]
    assert R.literals("(يوم|عام) (الخندق|الاحزاب)|حفر") == ["الاحزاب", "الخندق", "حفر"]
    assert R.literals(r"(?:^|\s)abc\s*[x.]?\s*$|d{2}ef+g") == ["abc", "ef"] and R.literals("(?=abc)d") == ["d"] and R.literals(r"\d+|a") == ["", "a"]
    tree = R.prefix_tree(sorted(set(R.shortest({"بدر", "بدر الكبري", "بني النضير", "بني قريظه"}).values())))
    assert all(re.search(tree, f"x{s}y") for s in ("بدر", "بني النضير", "بني قريظه")) and not re.search(tree, "بني كذا")


def test_the_events_as_a_table(spark):
    """Texts of every event's strings, and a table that is changed."""
    texts = [f"{part.strip('()')} {word}" for _, _, p, _ in rules.EVENTS for word in R.literals(p) for part in ("يوم", "غزوه", "قتل", "")]
    texts = [*texts, *(f"{a} {b}" for a, b in zip(texts, texts[7:])), None, ""]
    rows = spark.createDataFrame([(i, t, i % 3 == 0) for i, t in enumerate(texts)], "i int, t string, marfu boolean")
    table = spark.createDataFrame(list(rules.EVENTS), "key string, year int, pattern string, confidence double")
    changed = table.where("key <> 'badr'").unionByName(spark.createDataFrame([("new", 3, "احد|بدر", 0.99), ("late", 90, "فتح [مق]كه", 1.0)], table.schema))
    for known in (table, changed):
        listed = R.rules_of(known)
        order = sorted(listed, key=lambda e: -e[3])
        got = {r.i: r.e for r in rows.select("i", rules.date_event(F.col("t"), F.col("marfu"), listed)["key"].alias("e")).collect()}
        for i, t in enumerate(texts):
            fits = [k for k, y, p, _ in order if t is not None and re.search(p, t) and not (i % 3 == 0 and y > rules.LAST_YEAR)]
            assert got[i] == (fits[0] if fits else None), t
    with pytest.raises(ValueError):
        R.rules_of(table, most=5)
    dates = spark.createDataFrame([("badr",), ("badr",), ("new",), ("gone",), (None,)], "event_key string")
    assert sorted(map(tuple, analytics.timeline_events(dates, changed).collect())) == [("new", 3, 1)]


def test_other_rules_as_tables(spark):
    one = lambda column, t: spark.createDataFrame([(t,)], "t string").select(column.alias("x")).first().x
    t = F.col("t")
    assert one(rules.extract_grade(t), "هذا حديث حسن صحيح غريب").grade_norm == "hasan_sahih" and one(rules.extract_grade(t), "لا شيء") is None
    assert one(rules.extract_grade(t, [("لا شيء", "x", "y")], "شيء"), "لا شيء").grade_ar == "x"
    assert one(rules.date_season(t, [("شتاء|برد", "winter")]), "في برد") == "winter" and one(rules.date_season(t), "في رمضان") == "ramadan"
    assert one(rules.match_companion(t, [("x", ("زيد", "عمرو بن زيد"), 1, 2)]), "عن عمرو بن زيد كذا").death == 2
    assert one(rules.match_companion(t, [("x", ("زيد",), 1, 2)]), "زيد بن عمرو") is None
    assert one(R.first_that_holds(t, [], F.lit), "a") is None
