"""Searches over postings against a scan of the texts."""

import math
import random

import pytest

from warraq.operators import postings
from warraq.operators.search import parse_search

LINES = ["a", "a b", '"a b"', '"a a"', '"a b a"', "a or b c", '"b c" -a', 'a -"b b"', 'c or "a b" -d -"c a"', "-a", "", "zz", 'a or "zz a"', "a a", '"c" or "c d" or e']


def scanned(texts, line):
    groups, excluded = parse_search(line)
    out = set()
    for i, text in texts.items():
        if text is None:
            continue
        w = text.split(" ")
        has = lambda p: any(w[k : k + len(p)] == p for k in range(len(w)))
        if any(all(map(has, g)) for g in groups) and not any(map(has, excluded)):
            wanted = {x for g in groups for p in g for x in p}
            out.add((i, round(sum(x in wanted for x in w) / (1 + math.log(len(w))), 5)))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = {i: " ".join(rng.choice("aaabbcde") for _ in range(rng.randrange(1, 14))) for i in range(200)}
    return out | {900: None, 901: "", 902: "a  b", 903: "a b  c", 904: "ab a", 905: "a"}


def test_every_form_of_a_search(spark, texts):
    index = postings.text_postings(spark.createDataFrame(list(texts.items()), "passage_id long, text_norm string").repartition(5))
    for line in LINES:
        want = scanned(texts, line)
        assert {(r.passage_id, r.score) for r in postings.fts_match(index, line, None).collect()} == want, line
        best = [(r.passage_id, r.score) for r in postings.fts_match(index, line, 7).collect()]
        assert best == sorted(want, key=lambda x: (-x[1], x[0]))[:7], line


def test_a_search_reads_its_own_terms(spark):
    rng = random.Random(7)
    words = [f"w{k:04d}" for k in range(3000)]
    rows = [(i, " ".join(["common", *rng.choices(words, k=60), "rare" if i == 17 else "x"])) for i in range(3000)]
    index = postings.text_postings(spark.createDataFrame(rows, "passage_id long, text_norm string").repartition(4))
    every = index.count()
    read = postings.rows_read(index.where("term in ('rare', 'w0001')").select("passage_id"))
    assert every == 3000 * 62 and read <= 3 * postings.PAGE_ROWS + every // 50, read
    assert postings.fts_match(index, "rare common").count() == 1
    parts = {r.f for r in index.where("term = 'common'").selectExpr("input_file_name() as f").distinct().collect()}
    assert index.where("term = 'common'").count() == 3000 and len(parts) >= 1


def test_no_texts(spark):
    index = postings.text_postings(spark.createDataFrame([], "passage_id long, text_norm string"))
    assert postings.fts_match(index, "a").collect() == []
