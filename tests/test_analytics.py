"""Reports on grades, chains and facets against inline rows."""

from warraq.operators import analytics, search


def test_grades_fall_into_buckets_in_any_spelling(spark):
    grades = ["ثقة ثبت", "ثقه", "صَدوق يهم", "لا بأس به", "صحابي", "لين", "مجهول", "كذاب", "متفق على توثيقه", "إمام", "لا يعرف", None]
    rows = spark.createDataFrame([(g,) for g in grades], "rijal_grade string")
    got = [(r.bucket, r.severity, r.n) for r in analytics.grade_buckets(rows).collect()]
    assert got == [("sahabi", 1, 1), ("thiqa", 2, 4), ("saduq", 3, 2), ("layyin", 5, 1), ("majhul", 7, 1), ("kadhdhab", 9, 1), ("other", 10, 1)]


def test_profile_by_class(spark):
    rows = spark.createDataFrame([("ثقه", "2", "ب"), (None, "2", "أ"), (None, "2", None), (None, "x", "أ"), ("لين", None, "أ"), (None, "10", None)], "rijal_grade string, tabaqa_no string, tabaqa_label string")
    got = [(r.part, r.key, r.label, r.n, r.total) for r in analytics.narrator_profile(rows).collect()]
    assert got == [("class", "2", "أ", 3, 4), ("class", "10", None, 1, 4), ("grade", "thiqa", None, 1, 2), ("grade", "layyin", None, 1, 2)]


def corpus(spark):
    works = spark.createDataFrame([(1, "w1", "matn"), (2, "w2", "matn"), (3, "w3", "rijal"), (4, "w4", "matn")], "work_id int, title_ar string, kind string")
    editions = spark.createDataFrame([(10, 1, "units", "matn"), (20, 2, "pages", "matn"), (30, 3, "units", "matn"), (40, 4, "pages", "matn")], "edition_id int, work_id int, source string, book_type string")
    passages = [(1, 10, "unit"), (2, 10, "unit"), (3, 10, "page"), (4, 20, "unit"), (5, 30, "unit"), (6, 40, "page"), (7, 20, "unit"), (8, 20, "unit")]
    passages = spark.createDataFrame([(i, e, k, str(i), "t" * 200) for i, e, k in passages], "passage_id long, edition_id int, kind string, unit_num string, text_raw string")
    chains = spark.createDataFrame(
        [(777, 1, 0.9, 5, ["dropped_mention", "dropped_mention"]), (778, 1, 0.4, None, ["speech_boundary"]), (779, 3, 0.7, -1, []), (780, 4, 0.9, 3, ["dropped_mention"]), (781, 5, 1.0, 1, ["dropped_mention", "no_matn_marker"])],
        "chain_id long, passage_id long, confidence double, sanad_end_raw int, flags array<string>",
    )
    return works, editions, passages, chains


def test_coverage_is_chains_by_units(spark):
    works, editions, passages, chains = corpus(spark)
    row = analytics.chain_quality(passages, chains).first()
    assert (row.units, row.chains, row.coverage, row.with_boundary, row.speech, row.no_marker, row.dropped, row.dropped_share) == (6, 5, 83.3, 4, 1, 1, 3, 60.0)
    got = [tuple(r) for r in analytics.chain_quality_by_work(works, editions, passages, chains).collect()]
    assert got == [("w2", 3, 1, 1, 33.3), ("w1", 2, 3, 1, 150.0)]  # the least covered first; no units, or no text of a report: left out


def test_review_takes_the_surest_dropped_mentions(spark):
    works, editions, passages, chains = corpus(spark)
    got = sorted((r.passage_id, r.title_ar, r["head"]) for r in analytics.review_sample(chains, passages, editions, works, 2).collect())
    assert got == [(1, "w1", "t" * 100), (5, "w3", "t" * 100)]


def test_facets_by_means_of_transmission(spark):
    _, editions, passages, chains = corpus(spark)
    links = spark.createDataFrame([(777, 1, "حدثنا"), (777, 2, "عن"), (779, 1, "اخبرني"), (780, 1, "انا"), (1, 1, "عن")], "chain_id long, pos int, verb string")
    left = lambda key: sorted(r.passage_id for r in search.search_facets(passages, editions, chains=chains, links=links, transmission=key).collect())
    assert left("ananah") == left("عن") == [1] and left("ikhbar") == [3, 4] and left("sama") == [1] and left("انا") == [4] and left("x") == []
