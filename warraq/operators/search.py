"""Keyword, vector and hybrid search, and filtered listings."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warraq.operators.analytics import TRANSMISSION
from warraq.operators.postings import fts_match
from warraq.registry import query
from warraq.sources.folders import shuffled, written


def parse_search(text: str) -> tuple[list[list[list[str]]], list[list[str]]]:
    """Alternatives (lists of phrases, a phrase is a list of words) and excluded phrases of a search
    line: words are all wanted, "..." is a phrase, ``or`` parts alternatives, ``-`` excludes."""
    import re

    groups, excluded = [[]], []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        tokens = (phrase or word).split()
        if not phrase and word.lower() == "or":
            groups.append([])
        elif tokens:
            (excluded if minus else groups[-1]).append(tokens)
    return [g for g in groups if g], excluded


FTS = "SELECT passage_id, round(len(list_filter(w, lambda x: x IN ('رسول', 'الله', 'بدر', 'تبوك'))) / (1 + ln(len(w))), 5) AS score FROM (SELECT passage_id, string_split(text_norm, ' ') AS w, concat(' ', text_norm, ' ') AS s FROM passages) WHERE (contains(s, ' رسول الله ') AND contains(s, ' بدر ') OR contains(s, ' تبوك ')) AND NOT contains(s, ' عمر ')"


@query("fts_match", FTS + " ORDER BY score DESC, passage_id LIMIT 50")
def _(t):
    return fts_match(t.postings, '"رسول الله" بدر or تبوك -عمر')


FORMS = {
    "word": ("تبوك", "contains(s, ' تبوك ')", ("تبوك",)),
    "both": ("رسول بدر", "contains(s, ' رسول ') AND contains(s, ' بدر ')", ("رسول", "بدر")),
    "phrase": ('"قال رسول الله"', "contains(s, ' قال رسول الله ')", ("قال", "رسول", "الله")),
    "either": ('تبوك or "يوم الجمل" or غريب', "(contains(s, ' تبوك ') OR contains(s, ' يوم الجمل ') OR contains(s, ' غريب '))", ("تبوك", "يوم", "الجمل", "غريب")),
    "without": ('الله -"رسول الله" -حسن', "contains(s, ' الله ') AND NOT contains(s, ' رسول الله ') AND NOT contains(s, ' حسن ')", ("الله",)),
}


def form_sql(name: str, holds: str, wanted: tuple[str, ...]) -> str:
    """The whole result of one form, every match with its score."""
    listed = ", ".join(f"'{w}'" for w in wanted)
    return f"""SELECT '{name}' AS form, passage_id, round(len(list_filter(w, lambda x: x IN ({listed}))) / (1 + ln(len(w))), 5) AS score
  FROM (SELECT passage_id, string_split(text_norm, ' ') AS w, concat(' ', text_norm, ' ') AS s FROM passages) WHERE {holds}"""


@query("fts_forms", " UNION ALL ".join(form_sql(name, holds, wanted) for name, (_, holds, wanted) in FORMS.items()))
def _(t):
    """Every form of a search line, with all that it matches."""
    parts = [fts_match(t.postings, line, None).select(F.lit(name).alias("form"), "passage_id", "score") for name, (line, *_) in FORMS.items()]
    return reduce(DataFrame.unionByName, parts)


@query("exact_match", "SELECT passage_id FROM passages WHERE contains(text_raw, 'قَالَ رسول')")
def _(t):
    return t.passages.where(F.col("text_raw").contains("قَالَ رسول")).select("passage_id")


def search_facets(passages, editions, works=None, subject_links=None, chains=None, links=None, types=None, grades=None, *, source=None, edition=None, work_kind=None, subject=None, transmission=None, type_norm=None, grade=None) -> DataFrame:
    """Passages left by the facets that are set; without a source the structural archive is left out.

    ``work_kind``: a book type of the edition (matn, service, page-archive), or else a kind of the work.
    ``transmission``: a class of means of transmission (sama, ikhbar, inba, ananah), or else a verb, that
    a link of one of the passage's chains has."""
    books = editions.where(F.col("source") == source) if source else editions.where("source <> 'archive'")
    if edition is not None:
        books = books.where(F.col("edition_id") == edition)
    if work_kind in ("matn", "service", "page-archive"):
        books = books.where(F.col("book_type") == work_kind)
    elif work_kind:
        books = books.join(works.where(F.col("kind") == work_kind).select("work_id"), "work_id", "left_semi")
    out = passages.join(books.select("edition_id"), "edition_id", "left_semi")
    if subject is not None:
        out = out.join(subject_links.where(F.col("subject_id") == subject), "passage_id", "left_semi")
    if transmission:
        linked = links.where(F.col("verb").isin(*TRANSMISSION.get(transmission, (transmission,)))).select("chain_id")
        out = out.join(chains.select("chain_id", "passage_id").join(linked, "chain_id", "left_semi"), "passage_id", "left_semi")
    if type_norm:
        out = out.join(types.where(F.col("type_norm") == type_norm), "passage_id", "left_semi")
    if grade:
        out = out.join(grades.where(F.col("grade_norm") == grade), "passage_id", "left_semi")
    return out


@query("search_facets", "SELECT passage_id FROM passages JOIN editions USING (edition_id) WHERE source <> 'archive' AND passage_id IN (SELECT passage_id FROM subject_links WHERE subject_id = 3) AND EXISTS (SELECT 1 FROM chains c JOIN links l USING (chain_id) WHERE c.passage_id = passages.passage_id AND l.verb IN ('اخبرنا', 'اخبرني', 'انا', 'ابنا')) AND passage_id IN (SELECT passage_id FROM types WHERE type_norm = 'marfu') AND passage_id IN (SELECT passage_id FROM grades WHERE grade_norm = 'daif')")
def _(t):
    return search_facets(t.passages, t.editions, t.works, t.subject_links, t.chains, t.links, t.types, t.grades, subject=3, transmission="ikhbar", type_norm="marfu", grade="daif").select("passage_id")


@query("search_facets_books", "SELECT 'edition' AS facet, passage_id FROM passages WHERE edition_id = 6 UNION ALL SELECT 'type', passage_id FROM passages JOIN editions USING (edition_id) WHERE book_type = 'page-archive' AND source <> 'archive' UNION ALL SELECT 'kind', passage_id FROM passages JOIN editions e USING (edition_id) JOIN works w USING (work_id) WHERE w.kind = 'rijal' AND source <> 'archive' UNION ALL SELECT 'source', passage_id FROM passages JOIN editions USING (edition_id) WHERE source = 'archive' UNION ALL SELECT 'verb', passage_id FROM passages p JOIN editions USING (edition_id) WHERE source <> 'archive' AND EXISTS (SELECT 1 FROM chains c JOIN links l USING (chain_id) WHERE c.passage_id = p.passage_id AND l.verb = 'عن')")
def _(t):
    left = lambda name, **facets: search_facets(t.passages, t.editions, t.works, **facets).select(F.lit(name).alias("facet"), "passage_id")
    return left("edition", edition=6).unionByName(left("type", work_kind="page-archive")).unionByName(left("kind", work_kind="rijal")).unionByName(left("source", source="archive")).unionByName(left("verb", chains=t.chains, links=t.links, transmission="عن"))


def named(narrators: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """Narrators whose name or one of whose aliases contains ``name``."""
    by_alias = aliases.where(F.col("alias_norm").contains(name)).select("narrator_id", F.lit(True).alias("_alias")).distinct()
    return narrators.join(by_alias, "narrator_id", "left").where(F.col("canonical_norm").contains(name) | F.col("_alias")).drop("_alias")


@query("narrator_name_search", "SELECT n.narrator_id, count(l.chain_id) AS mentions FROM narrators n LEFT JOIN links l USING (narrator_id) WHERE contains(canonical_norm, 'سفيان') OR n.narrator_id IN (SELECT narrator_id FROM aliases WHERE contains(alias_norm, 'سفيان')) GROUP BY 1 ORDER BY mentions DESC, 1 LIMIT 20")
def _(t):
    mentions = t.links.where("narrator_id is not null").groupBy("narrator_id").agg(F.count("*").alias("mentions"))
    return named(t.narrators, t.aliases, "سفيان").select("narrator_id").join(mentions, "narrator_id", "left").fillna(0).orderBy(F.desc("mentions"), "narrator_id").limit(20)


#: Sort orders of the directory, ties by id.
SORTS = {
    "mentions": lambda: F.desc("mentions"), "chains": lambda: F.desc("chains"), "death": lambda: F.asc_nulls_last("death_year_h"),
    "death_desc": lambda: F.desc_nulls_last("death_year_h"), "name": lambda: F.asc("canonical_ar"), "id": lambda: F.asc("narrator_id"),
}


def narrator_directory(
    t, *, name=None, narrator_id=None, generation=None, grade=None, place=None, death_from=None, death_to=None, teacher=None, student=None, edition=None, topic=None, least_mentions=0, sort="mentions", n=25, offset=0
) -> DataFrame:
    """A page of narrators by the filters that are set, with mentions, chains and the books of the page's
    narrators.  ``t``: the tables narrators, aliases, links, chains, passages, subjects, subject_links.

    Filters on other tables are semi-joins; books are counted for the page alone."""
    from warraq.operators.graph import consecutive_pairs

    rows = named(t.narrators, t.aliases, name) if name else t.narrators
    for column, wanted in (("narrator_id", narrator_id), ("generation", generation)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    if grade:
        rows = rows.where(F.col("rijal_grade").contains(grade))
    if place:
        rows = rows.where(F.exists("places", lambda p: p.contains(place)))
    if death_from is not None:
        rows = rows.where(F.col("death_year_h") >= death_from)
    if death_to is not None:
        rows = rows.where(F.col("death_year_h") <= death_to)
    for role, other, wanted in (("student", "teacher", teacher), ("teacher", "student", student)):
        if wanted:
            people = t.narrators.where(F.col("canonical_norm").contains(wanted)).select(F.col("narrator_id").alias(other))
            pairs = consecutive_pairs(t.links, same=True).join(people, other, "left_semi")
            rows = rows.join(pairs.select(F.col(role).alias("narrator_id")), "narrator_id", "left_semi")
    mentions = t.links.where("narrator_id is not null")
    placed = lambda passages: mentions.join(t.chains.select("chain_id", "passage_id"), "chain_id").join(passages, "passage_id", "left_semi")
    if edition is not None:
        rows = rows.join(placed(t.passages.where(F.col("edition_id") == edition)), "narrator_id", "left_semi")
    if topic:
        about = t.subject_links.join(t.subjects.where(F.col("title_norm").contains(topic)).select("subject_id"), "subject_id", "left_semi")
        rows = rows.join(placed(about), "narrator_id", "left_semi")
    per_chain = mentions.groupBy("narrator_id", "chain_id").agg(F.count("*").alias("k"))
    stats = per_chain.groupBy("narrator_id").agg(F.sum("k").alias("mentions"), F.count("*").alias("chains"))
    rows = rows.join(stats, "narrator_id", "left").fillna(0, ["mentions", "chains"]).where(F.col("mentions") >= least_mentions)
    page = rows.orderBy(SORTS[sort](), "narrator_id").offset(offset).limit(n)
    books = mentions.join(page.select("narrator_id"), "narrator_id", "left_semi").join(t.chains.select("chain_id", "passage_id"), "chain_id").join(t.passages.select("passage_id", "edition_id"), "passage_id")
    books = books.select("narrator_id", "edition_id").distinct().groupBy("narrator_id").agg(F.count("*").alias("books"))
    return page.join(books, "narrator_id", "left").fillna(0, ["books"])


@query("narrator_directory_filter", "SELECT narrator_id FROM narrators WHERE contains(rijal_grade, 'ثقه') AND len(list_filter(places, lambda p: contains(p, '3'))) > 0 AND death_year_h BETWEEN 30 AND 120 AND narrator_id IN (SELECT narrator_id FROM links GROUP BY 1 HAVING count(*) >= 5) ORDER BY narrator_id LIMIT 1000")
def _(t):
    return narrator_directory(t, grade="ثقه", place="3", death_from=30, death_to=120, least_mentions=5, sort="id", n=1000).select("narrator_id")


NEXT = "SELECT a.narrator_id AS student, b.narrator_id AS teacher FROM links a JOIN links b ON b.chain_id = a.chain_id AND b.pos = a.pos + 1"


@query("narrator_directory_people", f"""WITH x AS ({NEXT}), s AS (SELECT narrator_id, count(*) AS mentions, count(DISTINCT chain_id) AS chains FROM links GROUP BY 1)
  SELECT n.narrator_id, mentions, chains, (SELECT count(DISTINCT edition_id) FROM links l JOIN chains USING (chain_id) JOIN passages USING (passage_id) WHERE l.narrator_id = n.narrator_id) AS books FROM narrators n JOIN s USING (narrator_id)
  WHERE generation = 'تابعي' AND n.narrator_id IN (SELECT student FROM x JOIN narrators t ON t.narrator_id = teacher WHERE contains(t.canonical_norm, 'مالك')) AND n.narrator_id IN (SELECT teacher FROM x JOIN narrators t ON t.narrator_id = student WHERE contains(t.canonical_norm, 'نافع'))
  AND n.narrator_id IN (SELECT narrator_id FROM links JOIN chains USING (chain_id) JOIN passages p USING (passage_id) WHERE p.edition_id % 2 = 0 AND p.edition_id = 4) AND n.narrator_id IN (SELECT narrator_id FROM links JOIN chains USING (chain_id) JOIN subject_links USING (passage_id) JOIN subjects USING (subject_id) WHERE contains(title_norm, '7'))
  AND (contains(n.canonical_norm, 'بن') OR false) ORDER BY mentions DESC, n.narrator_id LIMIT 25""")
def _(t):
    return narrator_directory(t, name="بن", generation="تابعي", teacher="مالك", student="نافع", edition=4, topic="7").select("narrator_id", "mentions", "chains", "books")


@query("directory_sorts", "WITH s AS (SELECT n.narrator_id, canonical_ar, death_year_h, count(l.chain_id) AS mentions, count(DISTINCT l.chain_id) AS chains FROM narrators n LEFT JOIN links l USING (narrator_id) GROUP BY ALL) " + " UNION ALL ".join(f"(SELECT '{k}' AS sort, narrator_id FROM s ORDER BY {v}, narrator_id LIMIT 20 OFFSET 3)" for k, v in {"mentions": "mentions DESC", "chains": "chains DESC", "death": "death_year_h ASC NULLS LAST", "death_desc": "death_year_h DESC NULLS LAST", "name": "canonical_ar", "id": "narrator_id"}.items()))
def _(t):
    parts = [narrator_directory(t, sort=sort, n=20, offset=3).select(F.lit(sort).alias("sort"), "narrator_id") for sort in SORTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def timeline_drill(dates, passages, editions, grades, *, event=None, years=None, season=None, companion=None, n=40, offset=0) -> DataFrame:
    """A page of dated passages by event, (first, last) year, season and companion, of which one at least is set."""
    wanted = {"event_key": event, "season": season, "companion_key": companion}
    if years is None and not any(wanted.values()):
        raise ValueError("an event, years, a season or a companion is needed")
    rows = dates
    for column, value in wanted.items():
        if value:
            rows = rows.where(F.col(column) == value)
    if years:
        rows = rows.where(F.col("year_best").between(*years))
    rows = rows.select("passage_id", "year_best").join(passages.select("passage_id", "edition_id"), "passage_id").join(editions.select("edition_id", "source"), "edition_id").join(grades.select("passage_id", "grade_norm"), "passage_id", "left")
    return rows.select("passage_id", "year_best", "source", "grade_norm").orderBy(F.asc_nulls_last("year_best"), "passage_id").offset(offset).limit(n)


DRILL = "SELECT {0} AS drill, d.passage_id, d.year_best, e.source, g.grade_norm FROM dates d JOIN passages p USING (passage_id) JOIN editions e USING (edition_id) LEFT JOIN grades g ON g.passage_id = d.passage_id WHERE {1} ORDER BY d.year_best NULLS LAST, d.passage_id LIMIT 40 OFFSET 5"


@query("timeline_drill", "(" + DRILL.format("'event'", "d.event_key = 'badr' AND d.year_best BETWEEN 1 AND 6") + ") UNION ALL (" + DRILL.format("'season'", "d.season = 'ramadan'") + ") UNION ALL (" + DRILL.format("'companion'", "d.companion_key = 'anas'") + ")")
def _(t):
    drill = lambda name, **how: timeline_drill(t.dates, t.passages, t.editions, t.grades, offset=5, **how).withColumn("drill", F.lit(name))
    return drill("event", event="badr", years=(1, 6)).unionByName(drill("season", season="ramadan")).unionByName(drill("companion", companion="anas"))


@query("subject_search", "SELECT s.subject_id, title, count(l.passage_id) AS n FROM subjects s LEFT JOIN subject_links l USING (subject_id) WHERE contains(title_norm, '1') GROUP BY 1, 2, length(title) ORDER BY length(title), 1 LIMIT 30")
def _(t):
    counted = t.subject_links.groupBy("subject_id").agg(F.count("*").alias("n"))
    found = t.subjects.where(F.col("title_norm").contains("1")).join(counted, "subject_id", "left").fillna(0, ["n"])
    return found.orderBy(F.length("title"), "subject_id").limit(30).select("subject_id", "title", "n")


def title_containment(questions: DataFrame, titles: DataFrame, top: int = 3, anchor: int = 5) -> DataFrame:
    """The longest ``top`` titles (work_id, title_norm) that a question (question_id, q) contains, or that
    contain a question of over 8 letters.

    The one within the other is known by its last ``anchor`` letters: these are joined with all runs
    of as many letters of the other, and only texts that share them are compared."""
    end = lambda c: F.right(c, F.least(F.length(c), F.lit(anchor)))
    runs = lambda c, least: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(least), F.lit(anchor)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substring(c, i, k))))))
    asked, known = questions.select("question_id", "q"), titles.select("work_id", "title_norm").where("title_norm <> ''")
    within = asked.withColumn("a", runs(F.col("q"), 1)).join(known.withColumn("a", end(F.col("title_norm"))), "a").where(F.col("q").contains(F.col("title_norm")))
    around = asked.where(F.length("q") > 8).withColumn("a", end(F.col("q"))).join(known.withColumn("a", runs(F.col("title_norm"), anchor)), "a").where(F.col("title_norm").contains(F.col("q")))
    longest = Window.partitionBy("question_id").orderBy(F.desc(F.length("title_norm")), "work_id")
    return within.unionByName(around).drop("a").distinct().withColumn("rn", F.row_number().over(longest)).where(F.col("rn") <= top).select("question_id", "work_id")


@query("title_containment", "WITH q AS (SELECT c_custkey AS question_id, CASE WHEN c_custkey % 40 = 0 THEN concat('كتاب nat', 'ion') ELSE concat('ما في كتاب nation_', c_nationkey, ' من باب') END AS q FROM customer WHERE c_custkey % 20 = 0) SELECT question_id, work_id FROM (SELECT question_id, work_id, row_number() OVER (PARTITION BY question_id ORDER BY length(title_norm) DESC, work_id) AS rn FROM q JOIN works ON contains(q, title_norm) OR length(q) > 8 AND contains(title_norm, q)) WHERE rn <= 3")
def _(t):
    """Every twentieth customer asks, after all titles."""
    text = F.when(F.col("c_custkey") % 40 == 0, "كتاب nation").otherwise(F.concat(F.lit("ما في كتاب nation_"), F.col("c_nationkey"), F.lit(" من باب")))
    return title_containment(t.customer.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("question_id"), text.alias("q")), t.works)


def trigrams(text: F.Column) -> F.Column:
    """Distinct trigrams of each word, padded with two spaces before and one after."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def trigram_word_similarity(a: DataFrame, b: DataFrame, least: float = 0.55, top: int = 3) -> DataFrame:
    """(a_id, b_id, similarity): over ``least`` of a's trigrams are in b.

    Texts with equal trigrams are one kind, on either side, and of a kind of b only its ``top`` lowest ids
    can be among the best; so kinds are compared, not rows.  Of n trigrams more than least * n are
    common, so one of a's n - floor(least * n) rarest is: only these are joined, and the pairs that
    they find are counted."""
    grams = lambda df: df.withColumn("g", F.array_sort(trigrams(F.col("text")))).where(F.size("g") > 0)
    lowest = lambda df, by: df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy("b_id"))).where(F.col("rn") <= top).drop("rn")
    held = lowest(grams(lowest(b.select("b_id", "text").where("text is not null"), "text")).select("b_id", "g"), "g")
    kinds = written(held.groupBy(F.col("g").alias("h")).agg(F.collect_list("b_id").alias("ids")).withColumn("k", F.monotonically_increasing_id()), "kinds")
    texts = written(grams(a.select("text").distinct()), "texts")
    x = written(texts.select("g").distinct().withColumn("a", F.monotonically_increasing_id()), "asked")
    index = kinds.select("k", F.explode("h").alias("t"))
    seen = index.groupBy("t").agg(F.count("*").alias("df"))
    ranked = x.select("a", F.size("g").alias("n"), F.explode("g").alias("t")).join(shuffled(seen), "t", "left").fillna(0, ["df"])
    place = F.row_number().over(Window.partitionBy("a").orderBy("df", "t"))
    probes = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.floor(F.col("n") * least)).where("df > 0").select("a", "t")
    found = probes.join(shuffled(index), "t").select("a", "k").distinct().join(shuffled(x), "a").join(shuffled(kinds), "k")
    share = F.round(F.size(F.array_intersect("g", "h")) / F.size("g"), 4)
    near = found.withColumn("similarity", share).where(F.col("similarity") > least).select("g", F.explode("ids").alias("b_id"), "similarity")
    best = Window.partitionBy("g").orderBy(F.desc("similarity"), "b_id")
    best = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    answers = texts.join(shuffled(best), "g").groupBy("text").agg(F.collect_list(F.struct("b_id", "similarity")).alias("of"))
    return a.select("a_id", "text").join(shuffled(answers), "text").select("a_id", F.explode("of").alias("x")).select("a_id", "x.b_id", "x.similarity")


@query("trigram_word_similarity", "WITH g AS (SELECT p_partkey AS id, p_name AS text FROM part), w AS (SELECT id, unnest(string_split(text, ' ')) AS w FROM g), t AS (SELECT DISTINCT id, substr(concat('  ', w, ' '), unnest(generate_series(1, length(w) + 1)), 3) AS t FROM w), n AS (SELECT id, count(*) AS n FROM t GROUP BY 1), s AS (SELECT a.id AS a_id, b.id AS b_id, round(count(*)::DOUBLE / n, 4) AS similarity FROM t a JOIN t b USING (t) JOIN n ON n.id = a.id WHERE a.id % 20 = 0 GROUP BY 1, 2, n) SELECT a_id, b_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY similarity DESC, b_id) AS rn FROM s WHERE similarity > 0.55) WHERE rn <= 3")
def _(t):
    """Every twentieth part against all."""
    return trigram_word_similarity(t.part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("a_id"), F.col("p_name").alias("text")), t.part.select(F.col("p_partkey").alias("b_id"), F.col("p_name").alias("text")))


@query("long_text_filters", "SELECT passage_id FROM passages WHERE length(text_raw) > 40 AND regexp_matches(unit_num, '^[0-9]+$') AND seq BETWEEN 100 AND 5000")
def _(t):
    return t.passages.where((F.length("text_raw") > 40) & F.col("unit_num").rlike("^[0-9]+$") & F.col("seq").between(100, 5000)).select("passage_id")


#: Vectors of a part of the corpus, about; cells at most; queries that are scored at once; what rounding can add to a similarity.
KNN_PART, KNN_CELLS, KNN_SLICE, KNN_SLACK = 4096, 4096, 256, 1e-4


def vector_scope(corpus: DataFrame, *, source=None, edition=None, kind=None) -> DataFrame:
    """Vectors by the filters that are set; without a source the structural archive is left out."""
    out = corpus.where(F.col("source") == source) if source else corpus.where("source <> 'archive'")
    for column, wanted in (("edition_id", edition), ("kind", kind)):
        out = out.where(F.col(column) == wanted) if wanted is not None else out
    return out


def best_chunks(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of the k vectors found (query_id, vec_id, similarity) the best of each passage, ranked anew;
    ``chunks``: (vec_id, passage_id, chunk_no)."""
    first = Window.partitionBy("query_id", "passage_id").orderBy(F.desc("similarity"), "chunk_no")
    best = found.drop("rank").join(chunks, "vec_id").withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "passage_id")))


def unit_rows(column) -> np.ndarray:
    """Vectors of an Arrow column with length 1; zero ones stay."""
    m = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _celled(pivots):
    """Rows (id, embedding) with the nearest pivot and the angle to it; zero vectors have cell -1."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                unit = unit_rows(batch.column(1))
                away = angles(unit, pivots)
                cell = np.where(np.abs(unit).sum(axis=1) > 0, away.argmin(axis=1), -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away.min(axis=1))], names=["id", "embedding", "cell", "angle"])

    return run


def _sent(pivots, cells, first_round):
    """Queries for the parts that they have to meet: those of their own cell, or those of other cells that
    can hold something as near as the k-th so far, by the triangle inequality of angles."""
    number, nearest, farthest, start, many = cells

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("cell").to_numpy()[:, None] == number[None, :]
            if first_round:
                sent = own
            else:
                to = angles(unit_rows(batch.column("embedding")), pivots)
                to = np.where(number >= 0, to[:, np.maximum(number, 0)], 0.0)
                least = np.maximum(0, np.maximum(to - farthest, nearest - to))
                kth = batch.column("kth").fill_null(-9.0).to_numpy()
                open_ = (np.cos(least) >= kth[:, None] - KNN_SLACK) | (number < 0) | (batch.column("cell").to_numpy() < 0)[:, None]
                sent = open_ & ~own
            row, at = np.nonzero(sent)
            times = many[at]
            row, part = np.repeat(row, times), np.repeat(start[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            for i in range(0, len(row), 4096):
                taken = batch.take(pa.array(row[i : i + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(part[i : i + 4096].astype(np.int32)), pa.array(np.ones(len(taken), np.int32)), taken.column("id"), taken.column("embedding")], names=["part", "side", "id", "embedding"])

    return run


def _nearest(k):
    """Vectors of a part, then the queries that were sent to it: the best k of each; parts come one after another."""

    def run(batches):
        part, held, ids, rows = None, [], None, None
        for batch in batches:
            key = batch.column("part").to_numpy().astype(np.int64) * 2 + batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                own = batch.slice(a, b - a)
                if b == a:
                    continue
                if key[a] // 2 != part:
                    part, held, rows = key[a] // 2, [], None
                if key[a] % 2 == 0:
                    held.append((own.column("id").to_numpy(), unit_rows(own.column("embedding"))))
                    continue
                if rows is None and held:
                    ids, rows = (np.concatenate(x) for x in zip(*held))
                if rows is None:
                    continue
                asked, unit = own.column("id").to_numpy(), unit_rows(own.column("embedding"))
                for i in range(0, len(asked), KNN_SLICE):
                    scores = np.round(unit[i : i + KNN_SLICE] @ rows.T, 4)
                    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                    found = np.repeat(asked[i : i + KNN_SLICE], order.shape[1]), ids[order].ravel(), np.take_along_axis(scores, order, 1).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "similarity"])

    return run


def knn_meetings(corpus: DataFrame, queries: DataFrame, k: int = 10, block: int = KNN_PART):
    """The two rounds of ``vector_knn``: (found, meetings, every), where found is (query_id, vec_id,
    similarity) from all parts, meetings the number of (query, part) rows and every that of all pairs."""
    spark = corpus.sparkSession
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    corpus = corpus.where(whole).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = queries.where(whole).select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = "query_id long, vec_id long, similarity double"
    total = corpus.count()
    if not total or queries.isEmpty():
        return spark.createDataFrame([], found), 0, 0
    # pivots are drawn by hash, KNN_CELLS at most, whatever the corpus
    wanted = min(KNN_CELLS, -(-total // block))
    drawn = corpus.orderBy(F.xxhash64("id"), "id").limit(wanted).select("embedding").toArrow()
    pivots = unit_rows(drawn.column("embedding"))
    schema = "id long, embedding array<double>, cell int, angle double"
    placed = written(corpus.mapInArrow(_celled(pivots), schema), "cells")
    asked = written(queries.mapInArrow(_celled(pivots), schema), "queries")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("nearest"), F.max("angle").alias("farthest")).orderBy("cell").collect()  # a row for each pivot
    many = np.array([-(-c.n // block) for c in cells])
    start = np.cumsum(many) - many
    known = (np.array([c.cell for c in cells]), np.array([c.nearest for c in cells]), np.array([c.farthest for c in cells]), start, many)
    sizes = spark.createDataFrame([(c.cell, int(s), int(m)) for c, s, m in zip(cells, start, many)], "cell int, start int, many int")
    parts = placed.join(F.broadcast(sizes), "cell").select((F.col("start") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int").alias("part"), F.lit(0).alias("side"), "id", "embedding")

    def round_(queries_, first):
        sent = queries_.mapInArrow(_sent(pivots, known, first), "part int, side int, id long, embedding array<double>")
        sent = written(sent, "sent")
        rows = parts.unionByName(sent).repartition("part").sortWithinPartitions("part", "side", "id")
        return written(rows.mapInArrow(_nearest(k), found), "near"), sent.count()

    near, met = round_(asked.withColumn("kth", F.lit(None).cast("double")), True)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    kth = near.withColumn("rank", best).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("similarity").alias("kth"))
    far, more = round_(asked.join(kth, "id", "left").select("id", "embedding", "cell", "angle", "kth"), False)
    return near.unionByName(far), met + more, asked.count() * int(many.sum())


def vector_knn(corpus: DataFrame, queries: DataFrame, k: int = 10, block: int = KNN_PART) -> DataFrame:
    """Exact cosine top-k for any number of queries.  Null vectors, or those with a null in them, are left
    out on both sides.

    Vectors lie in the cells of their nearest pivots, large cells in several parts, and are not copied;
    queries are sent to parts.  A query meets its own cell first, and with its k-th best from there only
    cells that may hold something as near: an angle to a pivot and the angles in its cell bound those
    between (zero vectors, which have no angle, are met by all)."""
    found, _, _ = knn_meetings(corpus, queries, k, block)
    rank = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


KNN = "SELECT query_id, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.label <> 0)) WHERE rank <= 10"


@query("vector_knn", KNN)
def _(t):
    return vector_knn(t.embeddings.where("label <> 0"), t.embeddings.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"))


CHUNKS = "SELECT vec_id, vec_id // 3 AS passage_id, vec_id % 3 AS chunk_no, CASE label % 3 WHEN 0 THEN 'units' WHEN 1 THEN 'archive' ELSE 'pages' END AS source, label AS edition_id, CASE WHEN vec_id % 2 = 0 THEN 'unit' ELSE 'page' END AS kind, embedding FROM embeddings"


@query("vector_knn_passages", f"WITH c AS ({CHUNKS}), s AS (SELECT a.vec_id AS query_id, b.vec_id, passage_id, chunk_no, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM embeddings a, c b WHERE a.vec_id % 20 = 0 AND b.source <> 'archive' AND b.kind = 'unit'), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rn FROM s) WHERE rn <= 50), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, passage_id ORDER BY similarity DESC, chunk_no) AS pn FROM k) WHERE pn = 1) SELECT query_id, passage_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, passage_id)::INT AS rank FROM p")
def _(t):
    """The best chunk of each passage among the nearest 50 of the units outside the archive."""
    source = F.element_at(F.array(F.lit("units"), F.lit("archive"), F.lit("pages")), F.col("label") % 3 + 1)
    chunks = t.embeddings.select("vec_id", F.floor(F.col("vec_id") / 3).alias("passage_id"), (F.col("vec_id") % 3).alias("chunk_no"), source.alias("source"), F.col("label").alias("edition_id"), F.when(F.col("vec_id") % 2 == 0, "unit").otherwise("page").alias("kind"), "embedding")
    near = vector_knn(vector_scope(chunks, kind="unit").select("vec_id", "embedding"), t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 50)
    return best_chunks(near, chunks.select("vec_id", "passage_id", "chunk_no")).select("query_id", "passage_id", "similarity", "rank")


def hybrid_rrf(keyword: DataFrame, vector: DataFrame, n: int = 20, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked frames (id, rank)."""
    a, b = keyword.select("id", F.col("rank").alias("r1")), vector.select("id", F.col("rank").alias("r2"))
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    return a.join(b, "id", "full_outer").select("id", F.round(part("r1") + part("r2"), 5).alias("score")).orderBy(F.desc("score"), "id").limit(n)


@query("hybrid_rrf", f"WITH a AS (SELECT passage_id AS id, row_number() OVER (ORDER BY score DESC, passage_id) AS r1 FROM ({FTS} ORDER BY score DESC, passage_id LIMIT 50)), b AS (SELECT vec_id AS id, rank AS r2 FROM (SELECT vec_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 0)) WHERE rank <= 50) SELECT id, round(coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0), 5) AS score FROM a FULL JOIN b USING (id) ORDER BY score DESC, id LIMIT 20")
def _(t):
    ranked = fts_match(t.postings, '"رسول الله" بدر or تبوك -عمر').select(F.col("passage_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("score"), "passage_id")).alias("rank"))
    near = vector_knn(t.embeddings, t.embeddings.where("vec_id = 0").withColumnRenamed("vec_id", "query_id"), 50).select(F.col("vec_id").alias("id"), "rank")
    return hybrid_rrf(ranked, near)


@query("union_search", "SELECT 'units' AS corpus, passage_id AS id, substr(text_norm, greatest(instr(text_norm, 'الله') - 20, 1), 60) AS snippet FROM passages WHERE kind = 'unit' AND contains(text_norm, 'الله') UNION ALL SELECT 'pages', passage_id, substr(text_norm, greatest(instr(text_norm, 'الله') - 20, 1), 60) FROM passages WHERE kind = 'page' AND contains(text_norm, 'الله')")
def _(t):
    def corpus(name, df):
        at = F.greatest(F.instr("text_norm", "الله") - 20, F.lit(1))
        return df.where(F.col("text_norm").contains("الله")).select(F.lit(name).alias("corpus"), F.col("passage_id").alias("id"), F.substring("text_norm", at, F.lit(60)).alias("snippet"))

    return corpus("units", t.passages.where("kind = 'unit'")).unionByName(corpus("pages", t.passages.where("kind = 'page'")))
