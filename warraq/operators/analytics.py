"""Corpus analytics: counts, distributions, coverage and quality reports, and their sorts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warraq.functions.arabic import normalize_arabic
from warraq.operators.ordering import neighbours, numbered
from warraq.operators.rules import EVENTS
from warraq.registry import query

count, distinct = F.count, F.countDistinct
resolved = "narrator_id is not null"


def totals(**frames: DataFrame) -> DataFrame:
    """One row with the number of rows of each frame."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # rows of one each
    return out


def labelled_counts(**frames: DataFrame) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n") for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("corpus_totals", "SELECT (SELECT count(*) FROM passages) AS passages, (SELECT count(*) FROM passages WHERE kind = 'unit') AS units, (SELECT count(*) FROM chains) AS chains, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM links WHERE narrator_id IS NOT NULL) AS resolved, (SELECT count(*) FROM narrators) AS narrators, (SELECT count(*) FROM grades) AS graded")
def _(t):
    return totals(passages=t.passages, units=t.passages.where("kind = 'unit'"), chains=t.chains, links=t.links, resolved=t.links.where(resolved), narrators=t.narrators, graded=t.grades)


def overview_by_book(editions, passages, chains, grades) -> DataFrame:
    """Units, chains, boundaries and grades per book of sources; joined rows count as they fan out."""
    rows = editions.join(passages.select("edition_id", "passage_id", "kind"), "edition_id", "left").join(chains.select("passage_id", "chain_id", "sanad_end_raw"), "passage_id", "left").join(grades.select("passage_id", "grade_norm"), "passage_id", "left")
    unit = F.col("kind") == "unit"
    return rows.groupBy("edition_id", "title_ar", "source").agg(F.count(F.when(unit, 1)).alias("units"), F.count("chain_id").alias("chains"), F.count(F.when(F.col("sanad_end_raw") > 0, 1)).alias("boundaries"), F.count("grade_norm").alias("graded")).where("units > 0")


@query("overview_by_book", "SELECT e.edition_id, e.title_ar, e.source, count(CASE WHEN p.kind = 'unit' THEN 1 END) AS units, count(chain_id) AS chains, count(CASE WHEN sanad_end_raw > 0 THEN 1 END) AS boundaries, count(grade_norm) AS graded FROM editions e JOIN works w USING (work_id) LEFT JOIN passages p ON p.edition_id = e.edition_id LEFT JOIN chains c ON c.passage_id = p.passage_id LEFT JOIN grades g ON g.passage_id = p.passage_id WHERE w.kind = 'matn' GROUP BY 1, 2, 3 HAVING units > 0 ORDER BY units DESC")
def _(t):
    matn = t.editions.join(t.works.where("kind = 'matn'").select("work_id"), "work_id", "left_semi")
    return overview_by_book(matn, t.passages, t.chains, t.grades).orderBy(F.desc("units"), "edition_id")


@query("grade_distribution", "SELECT grade_norm, source, count(*) AS n FROM grades GROUP BY 1, 2")
def _(t):
    return t.grades.groupBy("grade_norm", "source").agg(count("*").alias("n"))


# Buckets of biographical grades by their first words (normalised), and their order of severity.
BUCKETS = (
    ("صحابي", "sahabi"), ("ثقه", "thiqa"), ("متفق", "thiqa"), ("امام", "thiqa"), ("صدوق", "saduq"), ("لا باس", "saduq"), ("مقبول", "maqbul"),
    ("لين", "layyin"), ("ضعيف", "daif"), ("مجهول", "majhul"), ("متروك", "matruk"), ("كذاب", "kadhdhab"),
)
SEVERITY = ("sahabi", "thiqa", "saduq", "maqbul", "layyin", "daif", "majhul", "matruk", "kadhdhab", "other")


def rijal_bucket(grade: F.Column) -> F.Column:
    """The bucket of a grade in any spelling; null without a grade."""
    norm = normalize_arabic(grade)
    out = F.when(grade.isNull(), None)
    for start, bucket in BUCKETS:
        out = out.when(norm.startswith(start), bucket)
    return out.otherwise("other")


def grade_buckets(narrators: DataFrame) -> DataFrame:
    """Graded narrators (rijal_grade) by bucket: bucket, severity (from 1, the best), n; best first."""
    counted = narrators.where("rijal_grade is not null").groupBy(rijal_bucket(F.col("rijal_grade")).alias("bucket")).agg(count("*").alias("n"))
    return counted.withColumn("severity", F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("bucket"))).orderBy("severity")


def narrator_profile(narrators: DataFrame) -> DataFrame:
    """Narrators by bucket of their grade and by class (tabaqa_no, tabaqa_label), with the total of each part:
    part, key, place, label, n, total.  A class is a number; its label is the usual one (of equally usual
    ones the first by spelling)."""
    grades = grade_buckets(narrators).select(F.lit("grade").alias("part"), F.col("bucket").alias("key"), "severity", F.lit(None).cast("string").alias("label"), "n")
    classed = narrators.where(F.col("tabaqa_no").rlike(r"^\d+$")).withColumn("place", F.col("tabaqa_no").cast("long"))
    usual = classed.where("tabaqa_label is not null").groupBy("place", "tabaqa_label").agg(count("*").alias("k"))
    usual = usual.groupBy("place").agg(F.min_by("tabaqa_label", F.struct(-F.col("k"), F.col("tabaqa_label"))).alias("label"))
    classes = classed.groupBy("place").agg(count("*").alias("n")).join(usual, "place", "left")
    rows = grades.withColumnRenamed("severity", "place").unionByName(classes.select(F.lit("class").alias("part"), F.col("place").cast("string").alias("key"), "place", "label", "n"))
    return rows.withColumn("total", F.sum("n").over(Window.partitionBy("part"))).orderBy("part", "place")


BUCKET_SQL = f"""SELECT bucket, list_position([{", ".join(f"'{x}'" for x in SEVERITY)}], bucket)::BIGINT AS severity, count(*) AS n
  FROM (SELECT CASE {" ".join(f"WHEN starts_with(rijal_grade, '{s}') THEN '{b}'" for s, b in BUCKETS)} ELSE 'other' END AS bucket FROM narrators WHERE rijal_grade IS NOT NULL) GROUP BY 1"""


@query("rijal_bucket", BUCKET_SQL)
def _(t):
    return grade_buckets(t.narrators)


@query("narrator_profile", f"""WITH g AS ({BUCKET_SQL}), c AS (SELECT tabaqa_no::BIGINT AS place, tabaqa_label AS label FROM narrators WHERE regexp_matches(tabaqa_no, '^[0-9]+$')),
  u AS (SELECT place, label FROM (SELECT place, label, row_number() OVER (PARTITION BY place ORDER BY count(*) DESC, label) AS rn FROM c WHERE label IS NOT NULL GROUP BY 1, 2) WHERE rn = 1)
  SELECT 'grade' AS part, bucket AS key, severity AS place, NULL::VARCHAR AS label, n, (SELECT sum(n) FROM g)::BIGINT AS total FROM g
  UNION ALL SELECT 'class', k.place::VARCHAR, k.place, u.label, k.n, (SELECT count(*) FROM c) FROM (SELECT place, count(*) AS n FROM c GROUP BY 1) k LEFT JOIN u USING (place)""")
def _(t):
    return narrator_profile(t.narrators)


def counted_pairs(rows: DataFrame, key: str, of: str, name: str) -> DataFrame:
    """The number of different ``of`` of each ``key``, by two aggregations with partial results instead of one that expands."""
    return rows.select(key, of).distinct().groupBy(key).agg(F.count("*").alias(name))


def per_narrator(links, chains, passages) -> DataFrame:
    """Mentions, chains, passages and editions per narrator: rows are one for each (narrator, chain), so
    chains are their number, and passages and editions are counted from what is left of them."""
    rows = links.where(resolved).groupBy("narrator_id", "chain_id").agg(F.count("*").alias("k")).join(chains.select("chain_id", "passage_id"), "chain_id").join(passages.select("passage_id", "edition_id"), "passage_id")
    each = rows.groupBy("narrator_id", "edition_id", "passage_id").agg(F.sum("k").alias("k"), F.count("*").alias("c"))
    books = each.groupBy("narrator_id", "edition_id").agg(F.sum("k").alias("k"), F.sum("c").alias("c"), F.count("*").alias("p"))
    return books.groupBy("narrator_id").agg(F.sum("k").alias("mentions"), F.sum("c").alias("chains"), F.sum("p").alias("passages"), F.count("*").alias("editions"))


def top_books(links, chains, passages, editions, works, n: int = 5) -> DataFrame:
    """The ``n`` works (narrator_id, title_ar, passages) with most passages of each narrator."""
    rows = links.where(resolved).select("narrator_id", "chain_id").distinct().join(chains.select("chain_id", "passage_id"), "chain_id").select("narrator_id", "passage_id").distinct()
    books = editions.select("edition_id", "work_id").join(works.select("work_id", "title_ar"), "work_id").select("edition_id", "title_ar")
    counted = rows.join(passages.select("passage_id", "edition_id"), "passage_id").groupBy("narrator_id", "edition_id").agg(count("*").alias("k")).join(books, "edition_id").groupBy("narrator_id", "title_ar").agg(F.sum("k").alias("passages"))
    best = Window.partitionBy("narrator_id").orderBy(F.desc("passages"), "title_ar")
    return counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


PER_NARRATOR = "SELECT narrator_id, count(*) AS mentions, count(DISTINCT chain_id) AS chains, count(DISTINCT passage_id) AS passages, count(DISTINCT edition_id) AS editions FROM links JOIN chains USING (chain_id) JOIN passages USING (passage_id) WHERE narrator_id IS NOT NULL GROUP BY 1"


@query("top_narrators", f"SELECT * FROM ({PER_NARRATOR}) ORDER BY mentions DESC, narrator_id LIMIT 25")
def _(t):
    return per_narrator(t.links, t.chains, t.passages).orderBy(F.desc("mentions"), "narrator_id").limit(25)


@query("chain_lengths", "SELECT hops, count(*) AS chains FROM (SELECT chain_id, count(*) AS hops FROM links GROUP BY 1) GROUP BY 1")
def _(t):
    return t.links.groupBy("chain_id").agg(count("*").alias("hops")).groupBy("hops").agg(count("*").alias("chains"))


@query("verb_counts", "SELECT verb, count(*) AS n FROM links GROUP BY 1")
def _(t):
    return t.links.groupBy("verb").agg(count("*").alias("n"))


#: Means of transmission.
TRANSMISSION = {"sama": ("حدثنا", "حدثني", "ثنا", "نا", "سمعت", "سمع"), "ikhbar": ("اخبرنا", "اخبرني", "انا", "ابنا"), "inba": ("انبانا", "انباني", "انبا"), "ananah": ("عن",)}


def transmission_class(verb: F.Column) -> F.Column:
    trimmed, out = F.trim(verb), None
    for name, verbs in TRANSMISSION.items():
        out = F.when(trimmed.isin(*verbs), name) if out is None else out.when(trimmed.isin(*verbs), name)
    return out


CLASS_SQL = "CASE " + " ".join("WHEN verb IN (" + ", ".join(f"'{v}'" for v in vs) + f") THEN '{k}'" for k, vs in TRANSMISSION.items()) + " END"


@query("transmission_class", f"SELECT chain_id, pos, {CLASS_SQL} AS class FROM links")
def _(t):
    return t.links.select("chain_id", "pos", transmission_class(F.col("verb")).alias("class"))


@query("taxonomy_counts", f"SELECT 'means' AS taxonomy, class AS key, sum(n)::BIGINT AS n FROM (SELECT verb, {CLASS_SQL} AS class, count(DISTINCT chain_id) AS n FROM links GROUP BY 1, 2) GROUP BY 2 UNION ALL SELECT 'type', type_norm, count(*) FROM types GROUP BY 2 UNION ALL SELECT 'grade', grade_norm, count(*) FROM grades GROUP BY 2")
def _(t):
    verbs = t.links.groupBy("verb").agg(distinct("chain_id").alias("n")).groupBy(transmission_class(F.col("verb")).alias("key")).agg(F.sum("n").alias("n"))
    part = lambda name, df: df.select(F.lit(name).alias("taxonomy"), "key", "n")
    return part("means", verbs).unionByName(part("type", t.types.groupBy(F.col("type_norm").alias("key")).agg(count("*").alias("n")))).unionByName(part("grade", t.grades.groupBy(F.col("grade_norm").alias("key")).agg(count("*").alias("n"))))


@query("distinct_verbs", f"SELECT DISTINCT c.passage_id, {CLASS_SQL} AS class FROM links JOIN chains c USING (chain_id)")
def _(t):
    return t.links.select("chain_id", "verb").distinct().join(t.chains.select("chain_id", "passage_id"), "chain_id").select("passage_id", transmission_class(F.col("verb")).alias("class")).distinct()


@query("timeline_coverage", "SELECT count(*) AS dated, count(year_best) AS exact_year, count_if(year_best IS NULL AND year_min IS NOT NULL) AS windowed, count_if(basis = 'season') AS season_only, count(season) AS seasonal FROM dates")
def _(t):
    return t.dates.agg(count("*").alias("dated"), count("year_best").alias("exact_year"), F.count_if(F.col("year_best").isNull() & F.col("year_min").isNotNull()).alias("windowed"), F.count_if(F.col("basis") == "season").alias("season_only"), count("season").alias("seasonal"))


@query("timeline_years", "SELECT year_best, count(*) AS n FROM dates WHERE year_best IS NOT NULL GROUP BY 1")
def _(t):
    return t.dates.where("year_best is not null").groupBy("year_best").agg(count("*").alias("n"))


def timeline_events(dates: DataFrame, events: DataFrame) -> DataFrame:
    """Dated passages (event_key) by event of a rule table (key, year, ...): event_key, year_ah, n; events
    that nothing is dated by are left out."""
    counted = dates.where("event_key is not null").groupBy("event_key").agg(count("*").alias("n"))
    return events.select(F.col("key").alias("event_key"), F.col("year").alias("year_ah")).join(counted, "event_key")


@query("timeline_events", f"SELECT e.event_key, e.year_ah, count(d.passage_id) AS n FROM (VALUES {', '.join(f'({k!r}, {y})' for k, y, _, _ in EVENTS)}) e(event_key, year_ah) LEFT JOIN dates d USING (event_key) GROUP BY 1, 2 HAVING count(d.passage_id) > 0")
def _(t):
    return timeline_events(t.dates, t.spark.createDataFrame(list(EVENTS), "key string, year int, pattern string, confidence double"))


@query("timeline_seasons", "SELECT season, count(*) AS n FROM dates WHERE season IS NOT NULL GROUP BY 1")
def _(t):
    return t.dates.where("season is not null").groupBy("season").agg(count("*").alias("n"))


@query("timeline_companions", "SELECT companion_key, count(*) AS n, min(year_min) AS first_year, max(year_max) AS last_year FROM dates WHERE companion_key IS NOT NULL GROUP BY 1 ORDER BY n DESC, companion_key LIMIT 40")
def _(t):
    return t.dates.where("companion_key is not null").groupBy("companion_key").agg(count("*").alias("n"), F.min("year_min").alias("first_year"), F.max("year_max").alias("last_year")).orderBy(F.desc("n"), "companion_key").limit(40)


@query("mention_counts_by_type", "SELECT basis, count(*) AS n, count(DISTINCT event_key) AS events, count(DISTINCT companion_key) AS companions FROM dates GROUP BY 1")
def _(t):
    return t.dates.groupBy("basis").agg(count("*").alias("n"), distinct("event_key").alias("events"), distinct("companion_key").alias("companions"))


@query("directory_stats", "SELECT n.narrator_id, coalesce(mentions, 0) AS mentions, coalesce(chains, 0) AS chains, coalesce(books, 0) AS books FROM narrators n LEFT JOIN (SELECT narrator_id, count(*) AS mentions, count(DISTINCT chain_id) AS chains FROM links GROUP BY 1) USING (narrator_id) LEFT JOIN (SELECT narrator_id, count(DISTINCT edition_id) AS books FROM links JOIN chains USING (chain_id) JOIN passages USING (passage_id) GROUP BY 1) USING (narrator_id)")
def _(t):
    stats = per_narrator(t.links, t.chains, t.passages).select("narrator_id", "mentions", "chains", F.col("editions").alias("books"))
    return t.narrators.select("narrator_id").join(stats, "narrator_id", "left").fillna(0, ["mentions", "chains", "books"])


@query("directory_facets", "SELECT 'generation' AS facet, generation AS key, count(*) AS n FROM narrators GROUP BY 2 UNION ALL (SELECT 'grade', rijal_grade, count(*) AS n FROM narrators WHERE rijal_grade IS NOT NULL GROUP BY 2 ORDER BY n DESC, 2 LIMIT 20) UNION ALL (SELECT 'place', place, count(*) AS n FROM (SELECT unnest(places) AS place FROM narrators) GROUP BY 2 ORDER BY n DESC, 2 LIMIT 30) UNION ALL SELECT 'book', w.title_ar, e.edition_id FROM editions e JOIN works w USING (work_id) WHERE EXISTS (SELECT 1 FROM passages p JOIN chains c USING (passage_id) WHERE p.edition_id = e.edition_id)")
def _(t):
    facet = lambda name, df: df.select(F.lit(name).alias("facet"), "key", "n")
    by = lambda col, df: df.groupBy(col.alias("key")).agg(count("*").alias("n"))
    grades = by(F.col("rijal_grade"), t.narrators.where("rijal_grade is not null")).orderBy(F.desc("n"), "key").limit(20)
    places = by(F.col("place"), t.narrators.select(F.explode("places").alias("place"))).orderBy(F.desc("n"), "key").limit(30)
    held = t.passages.join(t.chains.select("passage_id"), "passage_id", "left_semi").select("edition_id").distinct()
    books = t.editions.join(held, "edition_id", "left_semi").select("edition_id", "work_id").join(t.works.select("work_id", F.col("title_ar").alias("key")), "work_id").select("key", F.col("edition_id").cast("long").alias("n"))
    return facet("generation", by(F.col("generation"), t.narrators)).unionByName(facet("grade", grades)).unionByName(facet("place", places)).unionByName(facet("book", books))


@query("narrator_profile_stats", "WITH l AS (SELECT * FROM links JOIN chains USING (chain_id) JOIN passages p USING (passage_id) WHERE narrator_id IS NOT NULL), w AS (SELECT chain_id, pos, narrator_id AS s, lead(pos) OVER v AS np, lead(narrator_id) OVER v AS te FROM links WINDOW v AS (PARTITION BY chain_id ORDER BY pos)), e AS (SELECT * FROM w WHERE np = pos + 1 AND s IS NOT NULL AND te IS NOT NULL AND s <> te) SELECT narrator_id, count(*) AS mentions, count(DISTINCT chain_id) AS chains, count(DISTINCT passage_id) AS passages, count(DISTINCT edition_id) AS editions, (SELECT count(DISTINCT te) FROM e WHERE s = narrator_id) AS teachers, (SELECT count(DISTINCT s) FROM e WHERE te = narrator_id) AS students FROM l GROUP BY 1")
def _(t):
    from warraq.operators.graph import consecutive_pairs

    pairs = consecutive_pairs(t.links).select("student", "teacher").distinct()
    teachers = pairs.groupBy(F.col("student").alias("narrator_id")).agg(count("*").alias("teachers"))
    students = pairs.groupBy(F.col("teacher").alias("narrator_id")).agg(count("*").alias("students"))
    return per_narrator(t.links, t.chains, t.passages).join(teachers, "narrator_id", "left").join(students, "narrator_id", "left").fillna(0, ["teachers", "students"])


@query("narrator_top_books", "WITH c AS (SELECT narrator_id, w.title_ar, count(DISTINCT passage_id) AS passages FROM links JOIN chains USING (chain_id) JOIN passages p USING (passage_id) JOIN editions e USING (edition_id) JOIN works w ON w.work_id = e.work_id WHERE narrator_id IS NOT NULL GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY narrator_id ORDER BY passages DESC, title_ar)::INT AS rank FROM c) WHERE rank <= 5")
def _(t):
    return top_books(t.links, t.chains, t.passages, t.editions, t.works)


@query("narrator_passages", "SELECT passage_id, min(pos) AS pos FROM links JOIN chains USING (chain_id) WHERE narrator_id = 9 GROUP BY 1 ORDER BY passage_id LIMIT 50 OFFSET 10")
def _(t):
    first = Window.partitionBy("passage_id").orderBy("pos")
    rows = t.links.where("narrator_id = 9").join(t.chains.select("chain_id", "passage_id"), "chain_id").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return rows.select("passage_id", "pos").orderBy("passage_id").offset(10).limit(50)


@query("works_with_editions", "SELECT work_id, string_agg(concat(source, ':', edition_id), ',' ORDER BY source, edition_id) AS editions FROM editions GROUP BY 1")
def _(t):
    listed = F.array_sort(F.collect_list(F.struct("source", "edition_id")))
    return t.editions.groupBy("work_id").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["source"], x["edition_id"])), ",").alias("editions"))


@query("catalog_units", "SELECT e.edition_id, count(CASE WHEN kind = 'unit' THEN 1 END) AS units, count(passage_id) AS passages FROM editions e LEFT JOIN passages p USING (edition_id) GROUP BY 1")
def _(t):
    counted = t.passages.groupBy("edition_id").agg(F.count_if(F.col("kind") == "unit").alias("units"), count("*").alias("passages"))
    return t.editions.select("edition_id").join(counted, "edition_id", "left").fillna(0)


@query("passage_isnad", "SELECT passage_id, chain_id, string_agg(concat(pos, ' ', verb, ' ', mention_norm), ' | ' ORDER BY pos) AS chain FROM links JOIN chains USING (chain_id) GROUP BY 1, 2")
def _(t):
    listed = F.array_sort(F.collect_list(F.struct("pos", "verb", "mention_norm")))
    chains = t.links.groupBy("chain_id").agg(listed.alias("links")).join(t.chains.select("chain_id", "passage_id"), "chain_id")
    return chains.select("passage_id", "chain_id", F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x["pos"], x["verb"], x["mention_norm"])), " | ").alias("chain"))


def chain_quality(passages: DataFrame, chains: DataFrame) -> DataFrame:
    """One row on the parse of a corpus: units, chains, coverage (chains in percent of units), those with a
    boundary, flags, dropped mentions in percent of the chains, and the mean confidence."""
    has = lambda f: F.count_if(F.array_contains("flags", f))
    found = chains.agg(
        count("*").alias("chains"), count("sanad_end_raw").alias("with_boundary"), has("speech_boundary").alias("speech"), has("no_matn_marker").alias("no_marker"),
        has("dropped_mention").alias("dropped"), F.round(F.avg("confidence"), 3).alias("confidence"),
    )
    share = lambda part, whole, digits: F.round(F.col(part) * 100.0 / F.greatest(F.col(whole), F.lit(1)), digits)
    both = totals(units=passages.where("kind = 'unit'")).crossJoin(found)  # a row each
    return both.withColumns({"coverage": share("chains", "units", 1), "dropped_share": share("dropped", "chains", 2)})


def chain_quality_by_work(works: DataFrame, editions: DataFrame, passages: DataFrame, chains: DataFrame) -> DataFrame:
    """Texts (title_ar) with units, chains, chains with a dropped mention, and coverage in percent, the least
    covered first; works without units are left out.  Chains are summed by passage first, so that
    nothing is counted as distinct."""
    each = chains.groupBy("passage_id").agg(count("*").alias("k"), F.count_if(F.array_contains("flags", "dropped_mention")).alias("d"))
    books = editions.select("edition_id", "work_id").join(works.where("kind = 'matn'").select("work_id", "title_ar"), "work_id")
    rows = passages.select("edition_id", "passage_id", "kind").join(each, "passage_id", "left").join(books, "edition_id")
    sums = rows.groupBy("title_ar").agg(F.count_if(F.col("kind") == "unit").alias("units"), F.coalesce(F.sum("k"), F.lit(0)).alias("chains"), F.coalesce(F.sum("d"), F.lit(0)).alias("flagged"))
    ratio = F.col("chains") / F.col("units")
    return sums.where("units > 0").withColumn("coverage", F.round(ratio * 100, 1)).orderBy(ratio, "title_ar")


@query("chain_quality", """SELECT *, round(100.0 * chains / greatest(units, 1), 1) AS coverage, round(100.0 * dropped / greatest(chains, 1), 2) AS dropped_share FROM (
  SELECT (SELECT count(*) FROM passages WHERE kind = 'unit') AS units, count(*) AS chains, count(*) FILTER (WHERE sanad_end_raw IS NOT NULL) AS with_boundary,
    count(*) FILTER (WHERE list_contains(flags, 'speech_boundary')) AS speech, count(*) FILTER (WHERE list_contains(flags, 'no_matn_marker')) AS no_marker,
    count(*) FILTER (WHERE list_contains(flags, 'dropped_mention')) AS dropped, round(avg(confidence), 3) AS confidence FROM chains)""")
def _(t):
    return chain_quality(t.passages, t.chains)


@query("chain_quality_by_work", """SELECT *, round(100.0 * chains / units, 1) AS coverage FROM (
  SELECT w.title_ar, count(DISTINCT p.passage_id) FILTER (WHERE p.kind = 'unit') AS units, count(DISTINCT c.chain_id) AS chains,
    count(DISTINCT c.chain_id) FILTER (WHERE list_contains(c.flags, 'dropped_mention')) AS flagged
  FROM editions e JOIN works w USING (work_id) JOIN passages p USING (edition_id) LEFT JOIN chains c ON c.passage_id = p.passage_id
  WHERE w.kind = 'matn' GROUP BY 1 HAVING count(*) FILTER (WHERE p.kind = 'unit') > 0)""")
def _(t):
    return chain_quality_by_work(t.works, t.editions, t.passages, t.chains)


@query("hop_percentiles", "SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY hops) AS median, min(hops) AS least, max(hops) AS most FROM (SELECT count(*) AS hops FROM links GROUP BY chain_id)")
def _(t):
    hops = t.links.groupBy("chain_id").agg(count("*").alias("hops"))
    return hops.agg(F.expr("percentile_disc(0.5) within group (order by hops)").cast("long").alias("median"), F.min("hops").alias("least"), F.max("hops").alias("most"))


JOBS = "SELECT passage_id, edition_id, CASE passage_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'stale' ELSE 'done' END AS status, substr(sha256(CASE WHEN passage_id % 5 = 1 THEN 'old' ELSE text_raw END), 1, 16) AS content_hash FROM passages WHERE passage_id % 7 <> 0"


def jobs(t) -> DataFrame:
    """A ledger bound to the passages: some are missing, some failed, some stale."""
    k = F.col("passage_id") % 5
    return t.passages.where("passage_id % 7 <> 0").select("passage_id", "edition_id", F.when(k == 0, "failed").when(k == 1, "stale").otherwise("done").alias("status"), F.left(F.sha2(F.when(k == 1, "old").otherwise(F.col("text_raw")), 256), F.lit(16)).alias("content_hash"))


@query("embedding_coverage", f"WITH j AS ({JOBS}), a AS (SELECT edition_id, count_if(status = 'done') AS embedded, count_if(status = 'failed') AS failed, max(passage_id) AS last_run FROM j GROUP BY 1), b AS (SELECT edition_id, count(*) AS passages, sum(length(text_raw))::BIGINT AS chars FROM passages GROUP BY 1) SELECT edition_id, passages, chars, coalesce(embedded, 0) AS embedded, coalesce(failed, 0) AS failed, last_run, round(chars / 2.5 / 1000000 * 0.15, 6) AS usd FROM b LEFT JOIN a USING (edition_id)")
def _(t):
    from warraq.functions.text import embedding_cost

    done = jobs(t).groupBy("edition_id").agg(F.count_if(F.col("status") == "done").alias("embedded"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("passage_id").alias("last_run"))
    whole = t.passages.groupBy("edition_id").agg(count("*").alias("passages"), F.sum(F.length("text_raw")).alias("chars"))
    return whole.join(done, "edition_id", "left").fillna(0, ["embedded", "failed"]).withColumn("usd", embedding_cost(F.col("chars")))


@query("embedding_scope", f"WITH j AS ({JOBS}) SELECT count(*) AS editions, count_if(edition_id IN (SELECT edition_id FROM j WHERE status = 'done')) AS embedded FROM editions WHERE source <> 'archive'")
def _(t):
    scope = t.editions.where("source <> 'archive'")
    some = jobs(t).where("status = 'done'").select("edition_id").distinct()
    return totals(editions=scope, embedded=scope.join(some, "edition_id", "left_semi"))


@query("translation_coverage", f"WITH j AS ({JOBS}) SELECT p.edition_id, count(j.passage_id) AS translated, count_if(j.status = 'done') AS authenticated, count_if(j.content_hash IS DISTINCT FROM substr(sha256(text_raw), 1, 16) AND j.passage_id IS NOT NULL) AS stale FROM passages p LEFT JOIN j USING (passage_id) GROUP BY 1")
def _(t):
    rows = t.passages.select("passage_id", "edition_id", F.left(F.sha2("text_raw", 256), F.lit(16)).alias("now")).join(jobs(t).select("passage_id", "status", "content_hash", F.lit(True).alias("has")), "passage_id", "left")
    return rows.groupBy("edition_id").agg(count("has").alias("translated"), F.count_if(F.col("status") == "done").alias("authenticated"), F.count_if(F.col("has") & ~F.col("content_hash").eqNullSafe(F.col("now"))).alias("stale"))


NINE = ("works", "editions", "passages", "toc", "subjects", "subject_links", "narrators", "chains", "links")


@query("admin_status", " UNION ALL ".join(f"SELECT 'table' AS what, '{x}' AS name, count(*) AS editions, NULL::BIGINT AS passages FROM {x}" for x in NINE) + " UNION ALL SELECT 'source', source, count(DISTINCT e.edition_id), count(passage_id) FROM editions e LEFT JOIN passages p USING (edition_id) GROUP BY 2")
def _(t):
    """Rows of nine tables, and editions and passages of each source."""
    tables = labelled_counts(**{x: getattr(t, x) for x in NINE}).select(F.lit("table").alias("what"), F.col("label").alias("name"), F.col("n").alias("editions"), F.lit(None).cast("long").alias("passages"))
    counted = t.passages.groupBy("edition_id").agg(count("*").alias("k"))
    sources = t.editions.join(counted, "edition_id", "left").groupBy(F.col("source").alias("name")).agg(count("edition_id").alias("editions"), F.coalesce(F.sum("k"), F.lit(0)).alias("passages"))
    return tables.unionByName(sources.withColumn("what", F.lit("source")))


@query("union_counts", "SELECT 'works' AS label, count(*) AS n FROM works UNION ALL SELECT 'editions', count(*) FROM editions UNION ALL SELECT 'passages', count(*) FROM passages UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'subjects', count(*) FROM subjects")
def _(t):
    return labelled_counts(works=t.works, editions=t.editions, passages=t.passages, links=t.links, subjects=t.subjects)


@query("subject_counts", "SELECT subject_id, count(*) AS n FROM subject_links GROUP BY 1 ORDER BY n DESC, subject_id LIMIT 15")
def _(t):
    return t.subject_links.groupBy("subject_id").agg(count("*").alias("n")).orderBy(F.desc("n"), "subject_id").limit(15)


def parity(pairs: dict) -> DataFrame:
    """Rows (name, source, target, status): of {name: (source, target, '=' or '<=')} whether the counts agree."""
    parts = []
    for name, (source, target, how) in pairs.items():
        row = totals(source=source, target=target)
        ok = F.col("target") == F.col("source") if how == "=" else F.col("target") <= F.col("source")
        parts.append(row.select(F.lit(name).alias("name"), "source", "target", F.when(ok, "OK").otherwise("DIFF").alias("status")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PARITY = {"passages": ("orders", "passages", "="), "subject_links": ("lineitem", "subject_links", "<="), "chains": ("orders", "chains", "="), "links": ("customer", "links", "<=")}


@query("parity", " UNION ALL ".join(f"SELECT name, source, target, CASE WHEN target {how} source THEN 'OK' ELSE 'DIFF' END AS status FROM (SELECT '{name}' AS name, (SELECT count(*) FROM {a}) AS source, (SELECT count(*) FROM {b}) AS target)" for name, (a, b, how) in PARITY.items()))
def _(t):
    return parity({name: (getattr(t, a), getattr(t, b), how) for name, (a, b, how) in PARITY.items()})


@query("corpus_inventory", "SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars, max(length(text)) AS longest FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


@query("number_prf", "WITH d AS (SELECT DISTINCT edition_id, unit_num AS n FROM passages WHERE regexp_matches(unit_num, '^[0-9]+$')), g AS (SELECT DISTINCT edition_id, CAST(passage_id % 2500 AS VARCHAR) AS n FROM passages) SELECT edition_id, hit, detected, gold, round(hit / detected::DOUBLE, 4) AS precision, round(hit / gold::DOUBLE, 4) AS recall, round(2.0 * hit / (detected + gold), 4) AS f1 FROM (SELECT edition_id, count(*) AS detected FROM d GROUP BY 1) JOIN (SELECT edition_id, count(*) AS gold FROM g GROUP BY 1) USING (edition_id) JOIN (SELECT d.edition_id, count(*) AS hit FROM d JOIN g ON d.edition_id = g.edition_id AND d.n = g.n GROUP BY 1) USING (edition_id)")
def _(t):
    found = t.passages.where(F.col("unit_num").rlike("^[0-9]+$")).select("edition_id", F.col("unit_num").alias("n")).distinct()
    gold = t.passages.select("edition_id", (F.col("passage_id") % 2500).cast("string").alias("n")).distinct()
    each = lambda df, name: df.groupBy("edition_id").agg(count("*").alias(name))
    rows = each(found, "detected").join(each(gold, "gold"), "edition_id").join(each(found.intersect(gold), "hit"), "edition_id")
    hit = F.col("hit")
    return rows.select("edition_id", "hit", "detected", "gold", F.round(hit / F.col("detected"), 4).alias("precision"), F.round(hit / F.col("gold"), 4).alias("recall"), F.round(hit * 2 / (F.col("detected") + F.col("gold")), 4).alias("f1"))


@query("detected_intersect", "SELECT unit_num AS n FROM passages WHERE edition_id = 0 INTERSECT SELECT unit_num FROM passages WHERE edition_id = 2")
def _(t):
    numbers = lambda e: t.passages.where(F.col("edition_id") == e).select(F.col("unit_num").alias("n"))
    return numbers(0).intersect(numbers(2))


@query("nl_sql_examples", "SELECT 'units of a book' AS question, title_ar AS key, count(*) AS n FROM passages p JOIN editions e USING (edition_id) WHERE e.title_ar = 'NATION_3' AND kind = 'unit' GROUP BY 2 UNION ALL SELECT 'books by source', source, count(*) FROM editions GROUP BY 2 UNION ALL SELECT 'sahih', 'sahih', count(*) FROM grades WHERE grade_norm = 'sahih' UNION ALL (SELECT 'narrators of a book', n.canonical_ar, count(*) AS n FROM links JOIN chains USING (chain_id) JOIN passages p USING (passage_id) JOIN narrators n ON n.narrator_id = links.narrator_id WHERE p.edition_id = 4 GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5) UNION ALL (SELECT 'subjects', title, count(*) AS n FROM subject_links JOIN subjects USING (subject_id) GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10) UNION ALL SELECT 'of a person', 'alias', count(DISTINCT passage_id) FROM links JOIN chains USING (chain_id) WHERE narrator_id IN (SELECT narrator_id FROM aliases WHERE alias_norm IN ('ابو نافع', 'نافع ابن عمر'))")
def _(t):
    ask = lambda q, df: df.select(F.lit(q).alias("question"), "key", "n")
    by = lambda df, col: df.groupBy(F.col(col).alias("key")).agg(count("*").alias("n"))
    units = by(t.passages.where("kind = 'unit'").join(t.editions.where("title_ar = 'NATION_3'").select("edition_id", "title_ar"), "edition_id"), "title_ar")
    top = t.links.join(t.chains.select("chain_id", "passage_id"), "chain_id").join(t.passages.where("edition_id = 4").select("passage_id"), "passage_id").join(t.narrators.select("narrator_id", "canonical_ar"), "narrator_id")
    subjects = t.subject_links.join(t.subjects.select("subject_id", "title"), "subject_id")
    person = t.aliases.where(F.col("alias_norm").isin("ابو نافع", "نافع ابن عمر")).select("narrator_id")
    told = t.links.join(person, "narrator_id", "left_semi").select("chain_id").distinct().join(t.chains.select("chain_id", "passage_id"), "chain_id").agg(F.countDistinct("passage_id").alias("n")).select(F.lit("alias").alias("key"), "n")
    more = ask("subjects", by(subjects, "title").orderBy(F.desc("n"), "key").limit(10)).unionByName(ask("of a person", told))
    return more.unionByName(ask("units of a book", units)).unionByName(ask("books by source", by(t.editions, "source"))).unionByName(ask("sahih", by(t.grades.where("grade_norm = 'sahih'"), "grade_norm"))).unionByName(ask("narrators of a book", by(top, "canonical_ar").orderBy(F.desc("n"), "key").limit(5)))


# windows, sorts and pages


@query("reading_seq", "SELECT passage_id, edition_id, row_number() OVER (PARTITION BY edition_id ORDER BY passage_id)::INT - 1 AS seq FROM passages")
def _(t):
    rows = numbered(t.passages.select("passage_id", "edition_id"), ["edition_id"], ["passage_id"])
    return rows.select("passage_id", "edition_id", (F.col("pos") - 1).cast("int").alias("seq"))


@query("unit_seq", "SELECT passage_id, row_number() OVER (PARTITION BY edition_id ORDER BY seq)::INT AS unit_seq FROM passages WHERE kind = 'unit'")
def _(t):
    rows = numbered(t.passages.where("kind = 'unit'").select("passage_id", "edition_id", "seq"), ["edition_id"], ["seq"])
    return rows.select("passage_id", F.col("pos").cast("int").alias("unit_seq"))


@query("position_gaps", "SELECT count_if(np - pos > 1) AS gaps FROM (SELECT pos, lead(pos) OVER (PARTITION BY chain_id ORDER BY pos) AS np FROM links)")
def _(t):
    ahead = F.lead("pos").over(Window.partitionBy("chain_id").orderBy("pos"))
    return t.links.select((ahead - F.col("pos")).alias("gap")).agg(F.count_if(F.col("gap") > 1).alias("gaps"))


@query("prev_next", "SELECT passage_id, lag(passage_id) OVER w AS prev_id, lead(passage_id) OVER w AS next_id FROM passages WINDOW w AS (PARTITION BY edition_id ORDER BY seq)")
def _(t):
    return neighbours(t.passages.select("passage_id", "edition_id", "seq"), ["edition_id"], ["seq"], "passage_id").select("passage_id", "prev_id", "next_id")


def numbered_page(df: DataFrame, order: list, n: int, offset: int) -> DataFrame:
    """A page of a total order with its row numbers: only the page's rows go through a window."""
    page = df.orderBy(*order).limit(offset + n)
    return page.withColumn("rn", F.row_number().over(Window.orderBy(*order))).where(F.col("rn") > offset)


@query("page_rank_number", f"SELECT narrator_id, mentions, rn FROM (SELECT *, row_number() OVER (ORDER BY mentions DESC, narrator_id)::INT AS rn FROM ({PER_NARRATOR})) WHERE rn > 20 AND rn <= 40")
def _(t):
    return numbered_page(per_narrator(t.links, t.chains, t.passages).select("narrator_id", "mentions"), [F.desc("mentions"), F.col("narrator_id")], 20, 20)


@query("distinct_on", "SELECT edition_id, passage_id FROM (SELECT edition_id, passage_id, row_number() OVER (PARTITION BY edition_id ORDER BY length(text_raw) DESC, passage_id) AS rn FROM passages) WHERE rn = 1")
def _(t):
    first = Window.partitionBy("edition_id").orderBy(F.desc(F.length("text_raw")), "passage_id")
    return t.passages.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("edition_id", "passage_id")


@query("shortest_mention", "SELECT narrator_id, min_by(mention_ar, concat(lpad(length(mention_ar)::VARCHAR, 4, '0'), mention_ar)) AS mention FROM links WHERE narrator_id IS NOT NULL GROUP BY 1")
def _(t):
    return t.links.where(resolved).groupBy("narrator_id").agg(F.min_by("mention_ar", F.struct(F.length("mention_ar"), F.col("mention_ar"))).alias("mention"))


@query("toc_first_passage", "WITH p AS (SELECT 1000 + o_custkey AS node_id, min(o_orderkey) AS passage_id FROM orders GROUP BY 1), n AS (SELECT a.node_id AS leaf, a.node_id AS up FROM toc a UNION ALL SELECT a.node_id, a.parent_id FROM toc a WHERE a.parent_id >= 0 UNION ALL SELECT a.node_id, b.parent_id FROM toc a JOIN toc b ON b.node_id = a.parent_id WHERE b.parent_id >= 0) SELECT up AS node_id, min(passage_id) AS passage_id FROM n JOIN p ON p.node_id = n.leaf GROUP BY 1")
def _(t):
    from warraq.operators.graph import ancestors

    placed = t.orders.groupBy((F.col("o_custkey") + 1000).alias("node_id")).agg(F.min("o_orderkey").alias("passage_id"))
    return ancestors(t.toc).join(placed, "node_id").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.min("passage_id").alias("passage_id"))


@query("page", "SELECT passage_id, edition_id FROM passages ORDER BY edition_id, passage_id LIMIT 100 OFFSET 300")
def _(t):
    return t.passages.select("passage_id", "edition_id").orderBy("edition_id", "passage_id").offset(300).limit(100)


def review_sample(chains: DataFrame, passages: DataFrame, editions: DataFrame, works: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` surest chains with a dropped mention (of equally sure ones those of the least ids), with number,
    title and the first letters of their text."""
    top = chains.where(F.array_contains("flags", "dropped_mention")).orderBy(F.desc("confidence"), "chain_id").limit(n)
    rows = top.select("chain_id", "passage_id", "confidence").join(passages.select("passage_id", "edition_id", "unit_num", F.left("text_raw", F.lit(100)).alias("head")), "passage_id")
    return rows.join(editions.select("edition_id", "work_id"), "edition_id").join(works.select("work_id", "title_ar"), "work_id").select("passage_id", "unit_num", "title_ar", "head", "confidence")


@query("review_sample", """SELECT c.passage_id, p.unit_num, w.title_ar, left(p.text_raw, 100) AS head, c.confidence
  FROM chains c JOIN passages p USING (passage_id) JOIN editions e ON e.edition_id = p.edition_id JOIN works w USING (work_id)
  WHERE list_contains(c.flags, 'dropped_mention') ORDER BY c.confidence DESC, c.chain_id LIMIT 5""")
def _(t):
    return review_sample(t.chains, t.passages, t.editions, t.works)


@query("random_sample", "SELECT passage_id FROM passages ORDER BY md5(concat(passage_id, ':7')), passage_id LIMIT 100")
def _(t):
    """The first of an order by a seeded hash: the same rows at any partitioning."""
    return t.passages.orderBy(F.md5(F.concat("passage_id", F.lit(":7"))), "passage_id").limit(100).select("passage_id")
