"""Operators whose queries have no SQL, against plain computations and inline rows."""

import hashlib
import random

from pyspark.sql import functions as F

from warraq.operators import chains, datasets, rules, segment


def test_biographical_entries(spark):
    texts = [
        "12 - سعيد بن زيد الكوفي، صدوق يهم، من الحادية عشرة، مات سنة أربعين",
        "4 - سعيد بن زيد، من العاشرة، مات سنة أربعين",
        "[ع] 7 - زيد بن أسلم المالكي المدني، ثقة، مات سنة خمس وثلاثين ومائة",
        "3 - عمر بن سعيد، صحابي جليل",
        "لا رقم هنا، ثقة",
        "",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.e for r in rows.select("i", rules.parse_rijal_entry(F.col("t")).alias("e")).orderBy("i").collect()]
    assert (got[0].entry_no, got[0].name_norm, got[0].grade, got[0].tabaqa) == (12, "سعيد بن زيد الكوفي", "صدوق يهم", 11)
    assert (got[0].death_year_h, got[0].inferred, got[0].places, got[0].school) == (240, True, ["الكوفة"], None)
    assert (got.pop(1).death_year_h) is None  # 40, 140 and 240 are all outside the years of the tenth class
    assert (got[1].entry_no, got[1].grade, got[1].tabaqa, got[1].death_year_h, got[1].inferred) == (7, "ثقه", None, 135, False)
    assert (got[1].places, got[1].school) == (["المدينة المنورة"], "مالكي")
    assert (got[2].entry_no, got[2].grade, got[2].tabaqa, got[2].death_year_h) == (3, "صحابي جليل", 1, None)
    assert got[3:] == [None, None, None]


def test_blocks_of_a_page(spark):
    pages = ["كتاب الإيمان\nسطر أول من المتن\nسطر ثان من المتن\n\nسطر بعد فراغ\nباب بدء الوحي\nباب آخر\nآخر سطر من المتن", "سطر وحيد من المتن", "", "\n\n"]
    rows = spark.createDataFrame(list(enumerate(pages)), "passage_id int, text_raw string")
    got = sorted((r.passage_id, r["from"], r.to, r.kind[0]) for r in rules.page_blocks(rows).collect())
    parts = [(i, pages[i][a:b], kind) for i, a, b, kind in got]
    assert parts == [
        (0, "كتاب الإيمان", "h"),
        (0, "سطر أول من المتن\nسطر ثان من المتن\n", "p"),
        (0, "سطر بعد فراغ\n", "p"),
        (0, "باب بدء الوحي", "h"),
        (0, "باب آخر", "h"),
        (0, "آخر سطر من المتن", "p"),
        (1, "سطر وحيد من المتن", "p"),
    ]


def test_boundary_from_spans(spark):
    rng, units, spans = random.Random(4), [], {}
    for k in range(60):
        ends = sorted(rng.sample(range(100), rng.randrange(2, 10)))
        spans[k] = [(a, b, rng.choice(["ISNAD", "MATN", "HNUM"])) for a, b in zip(ends, ends[1:])]
        rng.shuffle(spans[k])
        start = rng.randrange(0, 50)
        units.append((k % 3, k, k, start, k if k % 2 else k + 1, start + rng.randrange(10, 50)))
    del spans[59]  # a unit without annotations is not answered
    frame = spark.createDataFrame(units, "edition_id int, unit_seq int, start_passage_id long, start_off int, end_passage_id long, end_off int")
    notes = spark.createDataFrame([(k, [dict(zip(("start", "end", "label"), s)) for s in v]) for k, v in spans.items()], "passage_id long, spans array<struct<start: int, end: int, label: string>>")
    got = {r.unit_seq: r.sanad_end_off for r in segment.sanad_end_from_spans(frame, notes).collect()}
    want = {}
    for _, k, first, start, last, end in units[:59]:
        inside = [s for s in spans[k] if s[1] > start and (first != last or s[0] < end)]
        found = [a for a, _, x in inside if x == "MATN" and a > start and any(y == "ISNAD" and b < a for b, _, y in inside)]
        want[k] = min(found, default=None)
    assert got == want and len({v is None for v in want.values()}) == 2


def test_vocalised_windows(spark):
    marked = "قَالَ رَسُولُ كَتَبَ عَمِلَ " * 12
    bare = "قال رسول كتب عمل " * 12
    rows = [(1, 2, marked), (2, 2, bare), (3, 1, marked), (4, 1, "قَالَ رَسُولُ"), (5, 1, ""), (6, 1, None)]
    frame = spark.createDataFrame(rows, "passage_id long, edition_id int, text_raw string")
    got = datasets.tashkeel_windows(frame, 100, F.col("edition_id") == 1).collect()
    assert [r.passage_id for r in got] == [3, 1]  # the preferred edition first
    assert all(r.text == marked.strip() for r in got)
    place = lambda r: int(hashlib.md5(f"{r.passage_id}:{r.n}".encode()).hexdigest(), 16) % 100
    assert [r.split for r in got] == ["train" if place(r) < 90 else "dev" if place(r) < 95 else "test" for r in got]
    assert [r.passage_id for r in datasets.tashkeel_windows(frame, 1, F.col("edition_id") == 2).collect()] == [1]


def test_graph_of_texts(spark):
    names = {1: "مالك", 2: "نافع", 3: "سالم"}
    texts = ["حدثنا مالك عن نافع عن سالم قال رسول الله كذا وكذا", "حدثنا مالك عن نافع قال رسول الله كذا وكذا", "حدثنا غريب عن سالم قال رسول الله كذا وكذا", ""]
    passages = spark.createDataFrame([(i, "unit", t, t) for i, t in enumerate(texts)], "passage_id long, kind string, text_raw string, text_norm string")
    narrators = spark.createDataFrame(list(names.items()), "narrator_id long, canonical_norm string")
    got = {(names[r.student], names[r.teacher]): r.weight for r in chains.graph_from_texts(passages, narrators).collect()}
    assert got == {("مالك", "نافع"): 2, ("نافع", "سالم"): 1}


def test_headings_that_a_page_shows(spark):
    lines = ["§ زيادة من المحقق", "[تنبيه مهم]", "[ص: 12]", "كِتَابُ الإيمَان", "*** باب النية ***", "فصل", "سطر عادي", "§§", "[12]", "x" * 170, "سورة البقرة"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    got = {r.i: r.k for r in rows.select("i", rules.display_heading(F.col("t")).alias("k")).collect()}
    assert got == {0: 3, 1: 3, 2: None, 3: 1, 4: 2, 5: 3, 6: None, 7: None, 8: None, 9: None, 10: 1}


def test_engine_output_by_token(spark):
    rows = spark.createDataFrame([(1, "والقلم وما كتب", "و+ال+قلم/NOUN و+ما/P/X"), (2, "a b", "a/T b+c d"), (3, "", "")], "passage_id long, text string, output string")
    got = {(r.passage_id, r.idx): (r.token, r.tag, r.parts) for r in datasets.aligned_output(rows).collect()}
    assert got == {
        (1, 0): ("والقلم", "NOUN", ["و", "ال", "قلم"]), (1, 1): ("وما", "X", ["و", "ما/P"]),
        (2, 0): ("a", "T", None), (2, 1): ("b", None, ["b", "c"]), (3, 0): ("", None, None),
    }


def test_analyses_whose_form_agrees(spark):
    forms = [(1, "كُتُب", 0, "كَتَبَ"), (1, "كُتُب", 1, "كُتِب"), (2, "قلم", 1, "قَلَمٌ"), (2, "قلم", 0, "قلما"), (3, "x", 2, "y"), (3, "x", 1, None), (4, "أحمد", 0, "حمد"), (4, "أحمد", 5, "احمد")]
    rows = spark.createDataFrame(forms, "token int, word string, place int, diac string")
    assert {r.token: r.place for r in datasets.picked_analyses(rows, ["token"]).collect()} == {1: 0, 2: 1, 3: 1, 4: 5}


def test_pages_that_name_a_text(spark):
    from warraq.operators import joins

    frame = spark.createDataFrame
    pages = frame([(1, "view_bookid_5_x_mainid_70_y"), (2, "view_bookid_5_x_mainid_71_y"), (3, "bookid_6_mainid_70_"), (4, "about"), (5, None), (6, "bookid_99999999999999999999_mainid_1_")], "page_id long, slug string")
    matn = frame([(5, 70, "t70"), (5, 71, "t71"), (6, 70, "u70")], "book_id long, main_id long, text_plain string")
    toc = frame([(5, 70, "h70"), (6, 70, "h6")], "book_id long, node_id long, title string")
    got = joins.page_refs(pages, matn, toc, frame([(5, "five")], "id long, name string")).collect()
    assert list(map(tuple, got)) == [(1, 5, 70, "t70", "h70", "five")]


def test_layers_get_the_ids_of_this_corpus(spark):
    from warraq.sources import sinks

    frame = spark.createDataFrame
    staged = frame([("a", 1, 3, "x"), ("a", 1, 3, "y"), ("a", 2, 3, "x"), ("b", 1, 3, "x"), ("a", 1, 4, "x")], "source string, source_book_id int, seq long, layer string")
    editions, passages = frame([("a", 1, 10), ("b", 1, 20)], "source string, source_book_id int, edition_id int"), frame([(10, 3, 777), (20, 4, 778)], "edition_id int, seq long, passage_id long")
    mapped = sinks.mapped_by_natural_key(staged, editions, passages)
    assert sorted(map(tuple, mapped.collect())) == [(777, "a", 1, 3, "x"), (777, "a", 1, 3, "y")]
    assert tuple(sinks.mapping_counts(staged, mapped).first()) == (5, 2, 3)


def test_snippets_from_each_boundary(spark):
    long = "قال رسول الله " + "كلمه " * 25
    rows = [
        (0, "عن زيد قال كذا وكذا", 7, [(0, 3, "ISNAD"), (8, 12, "MATN")]),  # the chain's end
        (1, "عن زيد قال كذا وكذا", 99, [(50, 60, "MATN"), (11, 19, "MATN"), (0, 3, "MATN")]),  # the first span within
        (2, "عن زيد § قال § كذا", None, [(0, 3, "ISNAD")]),  # the section sign
        (3, "يقول كذا " + long, 0, []),  # the last marker
        (4, "عن زيد يقول كذا", -1, None),  # a marker with too little behind it
        (5, "", 3, None),
        (6, None, 3, None),
    ]
    data = spark.createDataFrame([(i, t, e, s and [dict(zip(("start", "end", "label"), x)) for x in s]) for i, t, e, s in rows], "i int, t string, e int, s array<struct<start: int, end: int, label: string>>")
    got = {r.i: r.x for r in data.select("i", rules.matn_snippet(F.col("t"), F.col("e"), F.col("s")).alias("x")).collect()}
    assert got == {0: "قال كذا وكذا", 1: "كذا وكذا", 2: "قال كذا", 3: "قال رسول الله " + " ".join(["كلمه"] * 17) + " …", 4: "عن زيد يقول كذا", 5: "", 6: None}


def test_a_narrator_goes_and_its_links_stay(spark):
    from warraq.operators import maintenance

    frame = spark.createDataFrame
    narrators, links = frame([(1, "a"), (2, "b"), (3, "c")], "narrator_id long, name string"), frame([(9, 0, 1), (9, 1, 2), (9, 2, None)], "chain_id long, pos int, narrator_id long")
    left, unresolved = maintenance.delete_entity(frame([(2,), (2,), (7,)], "narrator_id long"), narrators, links)
    assert {r.narrator_id for r in left.collect()} == {1, 3} and sorted(map(tuple, unresolved.collect())) == [(9, 0, 1), (9, 1, None), (9, 2, None)]


def test_spans_with_enough_of_both_parts(spark):
    rows = [(0, [(0, 20, "ISNAD"), (20, 30, "ISNAD"), (30, 70, "MATN")]), (1, [(0, 29, "ISNAD"), (30, 90, "MATN")]), (2, [(0, 40, "ISNAD"), (40, 79, "MATN")]), (3, [])]
    data = spark.createDataFrame([(i, [dict(zip(("start", "end", "label"), x)) for x in s]) for i, s in rows], "i int, s array<struct<start: int, end: int, label: string>>")
    assert [r.i for r in data.where(datasets.usable_spans(F.col("s"))).collect()] == [0] and data.where(datasets.usable_spans(F.col("s"), 29, 39)).count() == 3
