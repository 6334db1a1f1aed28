"""Text functions and row rules against the semantics, on inline rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from warraq.functions import arabic as A
from warraq.functions import marks as M
from warraq.functions import text as X
from warraq.operators import chains, joins, rules, search, segment

REPORT = "حدثنا عبد الله بن يوسف قال أخبرنا مالك عن نافع عن عبد الله بن عمر أن رسول الله صلى الله عليه وسلم قال : « إنما الأعمال بالنيات »"
PAGE = "كتاب الإيمان\nباب بدء الوحي\n1 - حدثنا الحميدي قال حدثنا سفيان عن يحيى\nتتمة السطر الأول\n2 - حدثنا عبد الله بن يوسف أخبرنا مالك عن هشام\nباب آخر\n3 - حدثنا يحيى بن بكير حدثنا الليث عن عقيل"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_normalize(spark):
    text = "قَالَ  أَحْمَدُ المؤمنة ئ ـ"
    got = one(spark, A.normalize_arabic(F.col("t")), t=text)
    assert got == "قال احمد المءمنه ء"
    assert one(spark, A.normalize_arabic(F.col("t")), t=got) == got
    assert M.with_map(text)[0] == got
    norm, at = M.with_map(text)
    assert len(norm) == len(at) and text[at[0]] == "ق"
    assert one(spark, A.normalize_arabic(F.col("t")), t=None) == ""


def test_folds_differ(spark):
    assert one(spark, A.fold_letters(F.col("t")), t="مؤمن شئ") == "مومن شي"
    assert one(spark, A.fold_heading(F.col("t")), t="مؤمن شئ") == "مؤمن شئ"


def test_marks_round_trip():
    text = "قَالَ رَسُولُ اللَّهِ"
    bare, classes = M.split(text)
    text = M.apply(bare, classes)  # shadda and vowel in one order
    assert M.split(text) == (bare, classes) and any(classes)
    assert M.transplanted(bare, text) == text
    assert M.transplanted("زيد", text) is None
    assert M.merged("قال ﴿قال﴾ قَال", {"قال": "قَالَ"}) == "قَالَ ﴿قال﴾ قَال"


def chunks_by_hand(text, size, overlap, slack):
    text, out, at = text.strip(), [], 0
    if len(text) <= size:
        return [text] if text else []
    while True:
        end = min(at + size, len(text))
        spaces = [i for i in range(max(at + size - slack, 0), end) if text[i] == " "] if end < len(text) else []
        end = spaces[-1] if spaces and spaces[-1] > at else end
        out.append(text[at:end].strip())
        if end == len(text):
            return [c for c in out if c]
        at = max(end - overlap, at + 1)


def test_chunks(spark):
    import random

    rng = random.Random(3)
    texts = ["", "   ", " a ", " " * 300 + "x" * 1498 + "  ", "y" * 5000, "z" * 1500, "w" * 1501 + " "]
    texts += ["".join(rng.choice("abcd ق\n" if k % 3 else "abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randrange(8000))) for k in range(30)]
    texts += [(" " * 250 + "v" * 10) * 40, "u" * 1400 + " " * 400 + "t" * 900]
    rows = spark.createDataFrame([*enumerate(texts), (999, None)], "i int, t string")
    for args in ((1500, 200, 300), (40, 7, 11)):
        got = {r.i: r.c for r in rows.select("i", X.chunk_text(F.col("t"), *args).alias("c")).collect()}
        assert got.pop(999) is None
        assert got == {i: chunks_by_hand(t, *args) for i, t in enumerate(texts)}


@pytest.mark.parametrize("key", ["1", "abc", "ق"])
def test_hash_split(spark, key):
    k = int(hashlib.md5(key.encode()).hexdigest(), 16) % 100
    assert one(spark, X.hash_split(F.col("t")), t=key) == ("train" if k < 90 else "dev" if k < 95 else "test")


def test_word_windows(spark):
    got = one(spark, X.word_windows(F.col("t"), 10), t="aa bb cc dd eeeeeeeeeeeeee f")
    assert got == ["aa bb cc", "dd", "eeeeeeeeeeeeee", "f"]


def test_strip_html(spark):
    assert one(spark, X.strip_html(F.col("t"), scripts=True), t="<script>x<1</script><p>a &amp; b</p>") == "a & b"


def test_year_words(spark):
    got = one(spark, rules.year_words(F.col("t")), t="خمس وثلاثين وماءه")
    assert (got.year, got.century) == (135, True)
    got = one(spark, rules.year_words(F.col("t")), t="اربعين وقيل خمسين")
    assert (got.year, got.century) == (40, False)


def test_infer_century(spark):
    assert one(spark, rules.infer_century(F.col("y"), F.col("k")), y=20, k=10) == 220
    assert one(spark, rules.infer_century(F.col("y"), F.col("k")), y=40, k=10) is None
    assert one(spark, rules.infer_century(F.col("y"), F.col("k")), y=99, k=5) == 99


def parsed(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "passage_id long, text_raw string")
    return chains.parsed_units(rows).orderBy("passage_id").collect()


def test_parse_isnad(spark):
    whole, none, bare, speech, long = parsed(spark, REPORT, "", "حدثنا مالك عن نافع", "حدثنا مالك عن نافع قال : هذا كلام", "عن " + "ا" * 70 + " حدثنا مالك عن نافع قال رسول الله كذا")
    assert len(whole.p.hops) >= 3 and any("عبد الله بن يوسف" in h["mention"] for h in whole.p.hops)
    assert REPORT[whole.sanad_end_raw :].startswith("أن رسول الله") and whole.p.confidence == 1.0 and whole.p.flags == []
    assert none.p.hops == [] and none.p.confidence == 0 and none.sanad_end_raw == -1
    assert bare.p.flags == ["no_matn_marker"] and bare.p.confidence == 0.7 and [h["verb"] for h in bare.p.hops] == ["حدثنا", "عن"]
    assert speech.p.flags == ["speech_boundary"] and speech.p.confidence == 0.9 and speech.p.hops[1]["mention"] == "نافع"
    assert long.p.flags == ["dropped_mention"] and [h["pos"] for h in long.p.hops] == [1, 2] and long.p.confidence == 0.8


def test_chains_against_a_plain_scan(spark):
    """Random units of verbs and names: hops are the words between the verbs, up to the opener."""
    import random

    rng, texts = random.Random(2), []
    for _ in range(80):
        hops = [(rng.choice(["حدثنا", "اخبرنا", "عن", "سمعت"]), " ".join(rng.choice(["مالك", "نافع", "سالم", "النبي"]) for _ in range(rng.randrange(1, 4)))) for _ in range(rng.randrange(1, 5))]
        hops = [(v, "زيد " + m) if v == "سمعت" else (v, m) for v, m in hops]
        texts.append((hops, " ".join(f"{v} {m}" for v, m in hops) + " قال رسول الله كذا وكذا"))
    rows = spark.createDataFrame([(i, "unit", t, t) for i, (_, t) in enumerate(texts)], "passage_id long, kind string, text_raw string, text_norm string")
    got = {(r.chain_id, r.pos): (r.verb, r.mention_norm) for r in chains.extract_chains(rows).collect()}
    want = {}
    for i, (hops, text) in enumerate(texts):
        first = text.find("عن النبي صلي")
        if len(hops) >= 2 and first < 0:
            want |= {(i, k): h for k, h in enumerate(hops) if not h[1].startswith("النبي")}
    assert got == want


def test_flat_page(spark):
    page = spark.createDataFrame([(1, PAGE)], "passage_id long, text_raw string")
    units = segment.segment_units_flat(page).orderBy("start").collect()
    assert [u.number for u in units] == [1, 2, 3] and any("باب" in u.heading for u in units)
    heads = rules.lines_of(page).select(F.lit(1).alias("edition_id"), "line_no", rules.heading_level(F.col("line")).alias("level")).where("level is not null")
    toc = segment.nested_toc(heads.withColumnRenamed("line_no", "ord")).orderBy("ord").collect()
    assert [r.parent_ord for r in toc] == [None, 0, 0]


def test_years_and_page_numbers_open_no_units(spark):
    body = "حدثنا مالك عن نافع عن ابن عمر ان رسول الله قال كذا وكذا"
    lines = [(7, 1), (8, 1), (256, 0), (9, 1), (3, 0), (10, 1)]
    text = "\n".join(f"  ({n}) - {body}" for n, _ in lines)
    units = segment.segment_units_flat(spark.createDataFrame([(1, text), (2, f"5 - {body}\n1432 - {body}")], "passage_id long, text_raw string"))
    got = sorted((u.passage_id, u.start, u.number) for u in units.collect())
    places = [(1, text.index(f"({n}) - ") + 1, n) for n, stays in lines if stays]
    assert got == [*places, (2, 0, 5), (2, len(f"5 - {body}\n"), 1432)]  # two numbers are no run


def test_units_across_pages(spark):
    pages = spark.createDataFrame([(1, 1, 1, "272 - (168) حدثنا مالك\nنص"), (2, 1, 2, "(3) حاشية\n(170) وحدثناه نافع\nباب جديد\nنص")], "passage_id long, edition_id int, seq int, text_raw string")
    units = segment.segment_units_pages(pages).orderBy("unit_seq").collect()
    assert [(u.unit_num, u.start_passage_id, u.end_passage_id) for u in units] == [("168", 1, 2), ("170", 2, 2)]
    assert units[0].local_num == "272" and units[1].repeat


def test_headings(spark):
    got = lambda line: one(spark, rules.heading_classify(F.col("t")), t=line)
    assert got("كتاب الصلاة").kind == 1 and got("- باب في الصوم").kind == 2 and got("[زيادة المحقق]").kind == 3
    assert got("[ص: 12]") is None and got("كلام عادي") is None and got("ا" * 170) is None


def test_reconcile():
    assert rules.reconciled([1, 2, 900, 3, 4]) == [0, 1, 3, 4]
    assert rules.reconciled([7, 3]) == [0, 1]


def test_type_guards(spark):
    kind = lambda text, gen=None: one(spark, rules.classify_type(F.col("t"), F.lit(None).cast("int"), F.lit(gen).cast("string")), t=text)
    assert kind("قال الله : ﴿اقرا﴾") is None
    assert kind("قال الله انا").type == "qudsi"
    assert kind("كلام", "صحابي").type == "mawquf"


def test_companions(spark):
    got = lambda name: one(spark, rules.match_companion(F.col("t")), t=name)
    assert got("معاويه بن قره") is None and got("معاويه").key == "muawiya" and got("انس بن مالك").key == "anas"


def test_matn_bounds(spark):
    text = "حَدثنا مالك عن نافع عن ابن عمر قال قال رسول الله انما الاعمال بالنيات وانما لكل امرئ ما نوى. رواه البخاري"
    span = lambda t: one(spark, rules.matn_span(F.col("t")), t=t)
    got = span(text)
    assert text[got.start :].startswith("قال رسول الله") and text[got.end :].strip().startswith("رواه")
    assert tuple(span("نص بلا علامة")) == (-1, -1) and tuple(span("")) == (-1, -1)
    spoken = "حدثنا مالك عن نافع عن ابن عمر قال: كنا جلوسا عن النبي صلى الله عليه وسلم قال من صام رمضان ايمانا واحتسابا غفر له"
    assert spoken[span(spoken).start :].startswith("قال: كنا")
    weak = "حدثنا مالك عن نافع عن ابن عمر عن النبي انه نهي عن بيع الغرر وعن بيع الحصاة وعن غيرهما"
    assert weak[span(weak).start :].startswith("عن النبي") and span(weak).end == -1


def test_chains_of_a_text(spark):
    text = "حَدَّثَنَا مالك عن نافع. وحدثنا سفيان عن سالم ثم اخبرنا غيره"
    got = one(spark, rules.segment_chains(F.col("t")), t=text)
    assert got == [0, text.index("وحدثنا")] and one(spark, rules.segment_chains(F.col("t")), t="حدثنا مالك") == []


def test_kin(spark):
    from warraq.operators.graph import kin_relation

    def kin(student, teacher, a=0, b=0):
        row = spark.createDataFrame([(student, teacher, a, b)], "s string, t string, a int, b int")
        return row.select(kin_relation(*(F.col(c) for c in "stab")).alias("r")).first().r

    assert kin("يزيد ابن سعيد", "سعيد") == "father" and kin("عائشه بنت طلحه", "طلحه") == "father"
    assert kin("محمد بن عمر بن علي", "علي بن ابي طالب") == "grandfather" and kin("هشام بن عروه", "عروه بن الزبير") == "father"
    assert kin("احمد بن ابي سلمه", "زيد بن ابي سلمه") == "brother" and kin("زيد بن علي", "زيد بن علي") == "teacher"
    assert kin("مالك بن انس", "نافع", 5, 5) == "peer" and kin("مالك بن انس", "نافع", 0, 0) == "teacher" and kin("", "نافع", 5, 5) == "teacher"
    assert kin("زيد بن ابا بكر", "ابي بكر") == "teacher" and kin("ابي بكر بن زيد", "زيد") == "father"


def test_marks_of_a_page():
    assert M.transplanted("قال، احمد", "قَالَ احمد") == "قَالَ، احمد" and M.transplanted("احمد", "أَحْمَد") == "اَحْمَد"
    assert M.transplanted("قال زيد", "قَالَ لنا زَيد") == "قَالَ زَيد"
    assert M.transplanted("قال زيد", "قَالَ " + "ب" * 9 + "زيد") is None and M.transplanted("قال", "") is None


def test_tail_of_the_chain_decides_the_type(spark):
    text = "حدثنا مالك عن نافع عن النبي صلى الله عليه وسلم قال لا يحل لاحد ان يفعل كذا"
    end = text.index("لا يحل")
    kind = lambda e: one(spark, rules.classify_type(F.col("t"), F.col("e"), F.lit(None).cast("string")), t=text, e=e)
    assert kind(end).type == "marfu_qawli"
    plain = one(spark, rules.classify_type(F.col("t"), F.col("e"), F.lit("تابعي")), t="ا" * 200 + " النبي " + "ا" * 200 + " تم", e=390)
    assert plain.type == "maqtu"


def test_archive_pages_are_numbered_over_the_edition(spark):
    from warraq.sources.corpus import archive_passages

    pages = [(f"s{i % 7}/{i:03d}", i % 3, f"sec{i % 5}") for i in range(90)]
    rows = spark.createDataFrame([(s, s, sec, o, "t", f"نص {s}", f"<p>{s}</p>") for s, o, sec in pages], "slug string, url string, section string, ord int, title string, text string, html string")
    got = archive_passages(rows.repartition(4), 9).collect()
    order = sorted((o, s) for s, o, _ in pages)
    assert {r.seq: r.html for r in got} == {i: f"<p>{s}</p>" for i, (_, s) in enumerate(order)} and all(r.kind == "page" and r.text_raw.startswith("نص") for r in got)


def test_deep_trees(spark):
    from warraq.operators.graph import ancestors, breadcrumbs, tree_depth

    nodes = spark.createDataFrame([(i, i - 1, f"n{i}") for i in range(14)] + [(50, 99, "orphan"), (51, 50, "leaf")], "node_id long, parent_id long, title string")
    assert {r.node_id: r.depth for r in tree_depth(nodes).collect()} == {i: i for i in range(14)} | {50: 0, 51: 1}
    assert ancestors(nodes).where("node_id = 13").count() == 14 and ancestors(nodes).where("node_id = 51").count() == 2
    assert {r.node_id: r.path for r in breadcrumbs(nodes).collect()}[13] == " > ".join(f"n{i}" for i in range(14))


def test_sequences_and_what_they_miss(spark):
    heads = [(1, 1, [4], True), (1, 2, [1], False), (1, 3, [1], True), (1, 4, [2, 3], False), (1, 5, [5], True), (1, 6, [4, 6], True), (1, 7, [4], False), (2, 1, [1, 2], True), (2, 2, [], True)]
    rows = spark.createDataFrame(heads, "edition_id int, seq long, numbers array<int>, opens boolean").repartition(3)
    got = segment.accept_sequence(rows)
    assert {(r.edition_id, r.seq) for r in got.where("accepted").collect()} == {(1, 3), (1, 4), (1, 7), (2, 1)} and got.count() == len(heads)
    known = spark.createDataFrame([(1, 6), (1, 2), (2, 2)], "edition_id int, number int")
    assert {tuple(r) for r in segment.missing_numbers(got, known).collect()} == {(1, 5), (1, 6)}


def test_units_of_many_editions_stream(spark):
    """Numbered lines over pages of several editions, against a plain loop."""
    import random

    rng, pages, want = random.Random(4), [], {}
    for e in range(4):
        open_, n = None, 0
        for seq in range(25):
            lines = []
            for _ in range(rng.randrange(1, 5)):
                kind = rng.randrange(4)
                lines.append(f"{(n := n + 1)} - نص" if kind == 0 else "باب جديد في كذا" if kind == 1 else "سطر عادي")
            text, passage, at = "\n".join(lines), e * 100 + seq, 0
            pages.append((passage, e, seq, text))
            for line in lines:
                if not line.startswith("سطر"):
                    if open_:
                        want[e, open_[0]] = (open_[1], open_[2], passage, at)
                        open_ = None
                    if line[0].isdigit():
                        open_ = (line.split()[0], passage, at)
                at += len(line) + 1
        if open_:
            want[e, open_[0]] = (open_[1], open_[2], passage, len(text))
    got = segment.segment_units_pages(spark.createDataFrame(pages, "passage_id long, edition_id int, seq int, text_raw string").repartition(5)).collect()
    assert {(u.edition_id, u.unit_num): (u.start_passage_id, u.start_off, u.end_passage_id, u.end_off) for u in got} == want
    assert all(sorted(u.unit_seq for u in got if u.edition_id == e) == list(range(1, 1 + sum(u.edition_id == e for u in got))) for e in range(4))


def test_frames_do_not_overlap(spark):
    aliases = spark.createDataFrame([(1, "مالك بن انس"), (2, "مالك بن انس"), (3, "انس بن مالك"), (4, "بن انس"), (5, "مالك بن انس"), (6, "مالك بن انس"), (7, "عن عن")], "narrator_id long, alias_norm string")
    asked = spark.createDataFrame([(1, "قال مالك بن انس بن مالك عن عن بن انس")], "question_id long, text string")
    got = joins.ground_frames(asked, aliases, ["عن"]).orderBy("start").collect()
    assert [(r.start, r.mention, r.candidates) for r in got] == [(1, "مالك بن انس", [1, 2, 5]), (8, "بن انس", [4])]


def test_numbering_without_one_window(spark):
    keys = [3, 9, 10, 25, 26, 27, 90]
    got = joins.numbered(spark.createDataFrame([(k,) for k in keys], "k int"), "k", width=10).collect()
    assert sorted((r.k, r.place) for r in got) == [(k, i) for i, k in enumerate(keys)]


def test_snippets(spark):
    text = " ".join("كلمه" if i % 40 else "هدف" for i in range(130))
    got = one(spark, X.snippet_highlight(F.split("t", " "), ["هدف"], most=40), t=text)
    assert got.count(" … ") == 1 and got.count("<mark>هدف</mark>") == 2 and one(spark, X.snippet_highlight(F.split("t", " "), ["لا"]), t=text) == ""


def test_bio_entities(spark):
    from warraq.operators.datasets import merge_bio_entities

    tags = ["I-A", "B-A", "I-A", "O", "I-A", "B-B", "B-A", "I-A"]
    rows = spark.createDataFrame([(1, i, f"w{i}", x) for i, x in enumerate(tags)], "passage_id long, idx int, token string, tag string")
    got = sorted((r.start_token, r.end_token, r.label, r.text) for r in merge_bio_entities(rows).collect())
    assert got == [(1, 2, "A", "w1 w2"), (5, 5, "B", "w5"), (6, 7, "A", "w6 w7")]


def test_pages_are_anchored(spark):
    pages = spark.createDataFrame([(1, 1, 1, "مقدمه الناشر\nنص"), (2, 1, 2, "كتاب الصلاه\nنص"), (3, 1, 3, "نص"), (4, 1, 4, "باب الاذان\nنص"), (5, 1, 5, "نص")], "passage_id long, edition_id int, seq int, text_raw string")
    nodes = segment.toc_nodes(pages)
    assert [(n.ord, n.parent_ord, n.depth) for n in nodes.orderBy("ord").collect()] == [(1, None, 1), (2, None, 1), (3, 2, 2)]
    assert {r.passage_id: r.node_ord for r in segment.anchor_pages(pages, nodes).collect()} == {1: 1, 2: 2, 3: 2, 4: 3, 5: 3}


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(c, p, (c * 7 + p) % 5) for c in range(40) for p in range(5)], "chain_id long, pos int, narrator_id long")
    from warraq.operators.graph import edges

    assert sorted(edges(rows.repartition(1)).collect()) == sorted(edges(rows.repartition(7)).collect())


def test_upserts_are_idempotent(spark):
    from warraq.sources import sinks

    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = sinks.upsert(old, new, ["k"])
    assert sorted(once.collect()) == sorted(sinks.upsert(once, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(sinks.insert_if_absent(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_broken_csv(spark):
    from warraq.sources import corpus

    lines = spark.createDataFrame([('1,7,"a, b\r c ""q""\r\r",3,2',), ("1,8,plain\rtwo,3,2\r",)], "value string")
    got = {r.id: r.segments for r in corpus.repaired_csv(lines).collect()}
    assert got == {"7": ["a, b", 'c "q"'], "8": ["plain", "two"]}


def test_search_syntax(spark):
    from warraq.operators.search import fts_match, parse_search

    assert parse_search('"a b" c or d -e') == ([[["a", "b"], ["c"]], [["d"]]], [["e"]])
    rows = spark.createDataFrame([(1, "a b c"), (2, "b a c"), (3, "d e"), (4, "d")], "passage_id long, text_norm string")
    assert {r.passage_id for r in fts_match(rows, '"a b" c or d -e').collect()} == {1, 4}


def test_vector_knn_takes_any_number_of_queries(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors, asked = rng.normal(size=(90, 4)), rng.normal(size=(10_050, 4))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.similarity) for r in search.vector_knn(corpus, queries, 3).collect()}
    assert len(got) == 3 * len(asked)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(asked) @ unit(vectors).T, 4)
    for i, row in enumerate(scores):
        for place, j in enumerate(sorted(range(len(row)), key=lambda j: (-row[j], j))[:3], 1):
            assert got[i, place][0] == j and abs(got[i, place][1] - row[j]) < 1e-9
    small = search.vector_knn(corpus, queries.where("query_id < 70"), 3, block=16)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.similarity) for r in small.collect()} == {x: v for x, v in got.items() if x[0] < 70}


def test_near_duplicates_are_found_anywhere_in_a_text(spark):
    import random

    rng = random.Random(5)
    known = [" ".join(f"w{int(rng.random() ** 2 * 60)}" for _ in range(rng.randrange(1, 26))) for _ in range(80)]
    changed = ["changed " + " ".join(x.split()[1:]) for x in known[:40]]
    fresh = changed + known[40:45] + [" ".join(x.split()[1:] + ["more"]) for x in known[45:60]] + [f"n{i} n{i + 1} w1" for i in range(10)] + [""]
    new = spark.createDataFrame(list(enumerate(fresh)), "passage_id long, text_norm string")
    corpus = spark.createDataFrame([(x,) for x in known], "text_norm string")
    mapped = spark.createDataFrame([(3,)], "passage_id long")

    def near(x, y):
        x, y = set(x.split()), set(y.split())
        return bool(x and y) and len(x & y) / min(len(x), len(y)) >= 0.9

    want = {i for i, x in enumerate(fresh) if i != 3 and not any(x == y or near(x, y) for y in known)}
    assert {r.passage_id for r in joins.near_duplicate_gate(new, corpus, mapped).collect()} == want
    assert any(i not in want and i != 3 for i in range(40)) and want
    sets = lambda df: df.select(F.array_sort(F.array_distinct(F.split("text_norm", " "))).alias("w"))
    few, many = (joins.near_token_sets(sets(new), sets(corpus), 0.9, n) for n in (7, 10_000))
    assert {tuple(r.w) for r in few.collect()} == {tuple(r.w) for r in many.collect()}
