"""Joins that load, resolve and crosswalk the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warraq.functions.text import canonical_tokens, ordered_token_hit, token_overlap, words
from warraq.functions.vectorized import once
from warraq.registry import query
from warraq.sources.folders import few, shuffled, written


def wire_parents(nodes: DataFrame) -> DataFrame:
    """Generated ids (row numbers within an edition) and the generated id of each parent; a negative or missing parent is null."""
    made = nodes.withColumn("toc_node_id", F.row_number().over(Window.partitionBy("edition_id").orderBy("ord", "node_id")))
    parent = made.select("edition_id", F.col("node_id").alias("parent_id"), F.col("toc_node_id").alias("parent"))
    return made.join(parent, ["edition_id", "parent_id"], "left").select("edition_id", "node_id", "toc_node_id", "parent")


@query("wire_parents", "WITH m AS (SELECT *, row_number() OVER (PARTITION BY edition_id ORDER BY ord, node_id)::INT AS toc_node_id FROM toc) SELECT a.edition_id, a.node_id, a.toc_node_id, b.toc_node_id AS parent FROM m a LEFT JOIN m b ON b.edition_id = a.edition_id AND b.node_id = a.parent_id")
def _(t):
    return wire_parents(t.toc)


def leaf_flags(nodes: DataFrame) -> DataFrame:
    parents = nodes.select(F.col("parent_id").alias("p")).where("p is not null").distinct()
    return nodes.join(parents, nodes.node_id == parents.p, "left").select("node_id", F.col("p").isNull().alias("is_leaf"))


@query("toc_leaf_flag", "SELECT node_id, NOT EXISTS (SELECT 1 FROM toc c WHERE c.parent_id = toc.node_id) AS is_leaf FROM toc")
def _(t):
    return leaf_flags(t.toc)


def anchored(passages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each passage (passage_id, edition_id, source_node) with the leaf of its edition that it names, null without one."""
    leaves = leaf_flags(nodes).where("is_leaf").join(nodes.select("node_id", "edition_id"), "node_id").select("edition_id", F.col("node_id").alias("source_node"), "node_id")
    return passages.join(leaves, ["edition_id", "source_node"], "left").select("passage_id", "node_id")


@query("anchor_toc", "SELECT o_orderkey AS passage_id, n.node_id FROM orders LEFT JOIN (SELECT edition_id, node_id FROM toc a WHERE NOT EXISTS (SELECT 1 FROM toc c WHERE c.parent_id = a.node_id)) n ON n.edition_id = o_orderkey % 4 AND n.node_id = CASE WHEN o_orderkey % 3 = 0 THEN 100 + o_custkey % 25 ELSE 1000 + o_custkey END")
def _(t):
    node = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 25 + 100).otherwise(F.col("o_custkey") + 1000)
    return anchored(t.orders.select(F.col("o_orderkey").alias("passage_id"), (F.col("o_orderkey") % 4).cast("int").alias("edition_id"), node.alias("source_node")), t.toc)


def numbered(rows: DataFrame, key: str, width: int = 10_000) -> DataFrame:
    """``rows`` with ``place``, their number from 0 in the order of a distinct whole ``key``: a window within
    each range of keys, and sums over the ranges' counts, instead of one window over all rows."""
    cell = F.floor(F.col(key) / width).alias("_cell")
    counts = rows.groupBy(cell).agg(F.count("*").alias("n"))
    first = counts.select("_cell", F.coalesce(F.sum("n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(key)) - 1
    return rows.withColumn("_cell", cell).withColumn("_rank", rank).join(first, "_cell").withColumn("place", F.col("_first") + F.col("_rank")).drop("_cell", "_first", "_rank")


def attach_edition_to_work(editions: DataFrame, works: DataFrame, new: DataFrame) -> DataFrame:
    """New editions (source_book_id, author) with the work of the known edition of the same book, or the
    next new work ids, and the work's author, or else their own."""
    known = editions.where("source = 'units'").select("source_book_id", F.col("work_id").alias("known_work"))
    known = known.join(works.select(F.col("work_id").alias("known_work"), F.col("author").alias("known_author")), "known_work", "left")
    joined = new.join(known, "source_book_id", "left")
    last = works.agg(F.coalesce(F.max("work_id"), F.lit(0)).alias("last"))  # one row
    fresh = numbered(joined.where("known_work is null"), "source_book_id").crossJoin(last)
    of = lambda df, work, created: df.select("source_book_id", work.cast("long").alias("work_id"), F.coalesce("known_author", "author").alias("author"), F.lit(created).alias("created"))
    return of(joined.where("known_work is not null"), F.col("known_work"), False).unionByName(of(fresh, F.col("last") + 1 + F.col("place"), True))


@query("attach_edition_to_work", "SELECT r AS source_book_id, CASE WHEN r < 25 THEN r ELSE 24 + row_number() OVER (PARTITION BY r >= 25 ORDER BY r) END::BIGINT AS work_id, CASE WHEN r < 25 AND r % 2 = 0 THEN concat('w', r) ELSE concat('a', r) END AS author, r >= 25 AS created FROM (SELECT CAST(s_suppkey AS INT) AS r FROM supplier)")
def _(t):
    new = t.supplier.select(F.col("s_suppkey").cast("int").alias("source_book_id"), F.concat(F.lit("a"), F.col("s_suppkey")).alias("author"))
    return attach_edition_to_work(t.editions, t.works.withColumn("author", F.when(F.col("work_id") % 2 == 0, F.concat(F.lit("w"), F.col("work_id")))), new)


def link_subjects(hits: DataFrame, subjects: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (subject, passage) pairs that resolve on both sides, and the number that doesn't."""
    known = hits.join(subjects.select("subject_id"), "subject_id", "left_semi").join(passages.select("passage_id"), "passage_id", "left_semi")
    missing = hits.join(subjects.select("subject_id"), "subject_id", "left_anti").unionByName(hits.join(subjects.select("subject_id"), "subject_id", "left_semi").join(passages.select("passage_id"), "passage_id", "left_anti"))
    return known.select("subject_id", "passage_id").distinct(), missing.agg(F.count("*").alias("missing"))


@query("link_subjects", "WITH h AS (SELECT p_size AS subject_id, l_orderkey AS passage_id FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM h WHERE subject_id IN (SELECT subject_id FROM subjects WHERE subject_id <= 40) AND passage_id % 10 <> 0)) AS linked, (SELECT count(*) FROM h WHERE subject_id > 40 OR passage_id % 10 = 0) AS missing")
def _(t):
    hits = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_size").alias("subject_id"), F.col("l_orderkey").alias("passage_id"))
    linked, missing = link_subjects(hits, t.subjects.where("subject_id <= 40"), t.orders.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("passage_id")))
    return linked.agg(F.count("*").alias("linked")).crossJoin(missing)


@query("search_join", "SELECT p.passage_id, e.title_ar, e.source, w.title_ar AS work_title FROM passages p JOIN editions e USING (edition_id) JOIN works w USING (work_id) WHERE contains(p.text_norm, 'بدر')")
def _(t):
    books = t.editions.join(t.works.select("work_id", F.col("title_ar").alias("work_title")), "work_id").select("edition_id", "title_ar", "source", "work_title")
    return t.passages.where(F.col("text_norm").contains("بدر")).join(books, "edition_id").select("passage_id", "title_ar", "source", "work_title")


@query("facet_exists", "SELECT passage_id FROM passages p WHERE EXISTS (SELECT 1 FROM subject_links s WHERE s.passage_id = p.passage_id AND subject_id = 7) AND EXISTS (SELECT 1 FROM grades g WHERE g.passage_id = p.passage_id AND grade_norm = 'sahih')")
def _(t):
    return t.passages.select("passage_id").join(t.subject_links.where("subject_id = 7"), "passage_id", "left_semi").join(t.grades.where("grade_norm = 'sahih'"), "passage_id", "left_semi")


@query("last_link_per_chain", "SELECT chain_id, max_by(narrator_id, pos) AS narrator_id FROM links WHERE narrator_id IS NOT NULL GROUP BY 1")
def last_link_per_chain(t):
    return t.links.where("narrator_id is not null").groupBy("chain_id").agg(F.max_by("narrator_id", "pos").alias("narrator_id"))


@query("best_boundary_per_passage", "SELECT passage_id, max_by(sanad_end_raw, confidence) AS sanad_end FROM chains WHERE sanad_end_raw IS NOT NULL GROUP BY 1")
def _(t):
    return t.chains.where("sanad_end_raw is not null").groupBy("passage_id").agg(F.max_by("sanad_end_raw", F.struct("confidence", -F.col("chain_id"))).alias("sanad_end"))


def latest_annotation(annotations: DataFrame) -> DataFrame:
    newest = Window.partitionBy("passage_id", "layer", "engine").orderBy(F.desc("version"))
    return annotations.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


@query("latest_annotation", "SELECT conv_id AS passage_id, role AS layer, max(turn) AS version FROM conversations GROUP BY 1, 2")
def _(t):
    rows = t.conversations.select(F.col("conv_id").alias("passage_id"), F.col("role").alias("layer"), F.lit("e").alias("engine"), F.col("turn").alias("version"))
    return latest_annotation(rows).select("passage_id", "layer", "version")


def resolve_mentions_create(links: DataFrame, aliases: DataFrame, least: int = 2) -> DataFrame:
    """Mentions seen ``least`` times without an alias, with the shortest raw form."""
    seen = links.groupBy("mention_norm").agg(F.count("*").alias("n"), F.min_by("mention_ar", F.struct(F.length("mention_ar"), F.col("mention_ar"))).alias("canonical_ar"))
    return seen.where(F.col("n") >= least).join(aliases.select(F.col("alias_norm").alias("mention_norm")), "mention_norm", "left_anti")


def resolve_mentions_link(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Unresolved links take the lowest narrator that has their mention as an alias."""
    lowest = aliases.groupBy(F.col("alias_norm").alias("mention_norm")).agg(F.min("narrator_id").alias("by_alias"))
    return links.join(lowest, "mention_norm", "left").withColumn("narrator_id", F.coalesce("narrator_id", "by_alias")).drop("by_alias")


@query("resolve_mentions_create", "SELECT mention_norm, count(*) AS n, min(mention_ar) AS canonical_ar FROM links WHERE mention_norm NOT IN (SELECT canonical_norm FROM narrators WHERE narrator_id % 2 = 0) GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    return resolve_mentions_create(t.links, t.narrators.where("narrator_id % 2 = 0").select("narrator_id", F.col("canonical_norm").alias("alias_norm")))


@query("resolve_mentions_link", "SELECT chain_id, pos, coalesce(l.narrator_id, a.narrator_id) AS narrator_id FROM links l LEFT JOIN (SELECT canonical_norm, min(narrator_id) AS narrator_id FROM narrators GROUP BY 1) a ON a.canonical_norm = l.mention_norm")
def _(t):
    return resolve_mentions_link(t.links, t.narrators.select("narrator_id", F.col("canonical_norm").alias("alias_norm"))).select("chain_id", "pos", "narrator_id")


def match_rijal_entries(narrators: DataFrame, entries: DataFrame, curated: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """Entries (entry_id, name_norm) by narrators whose tokens agree: blocked on the first two, then
    all or the first four; one exact candidate or one at all is a match, more are ambiguous.

    ``curated`` (entry_id, narrator_id) settles its entries before; those of ``skipped`` (entry_id: notes,
    curated facts) are left out.  Names are compared once each, with the number that bear them."""
    if skipped is not None:
        entries = entries.join(skipped.select("entry_id"), "entry_id", "left_anti")
    todo = entries if curated is None else entries.join(curated.select("entry_id"), "entry_id", "left_anti")
    tokens = lambda df, name, side: df.withColumn(f"{side}_t", canonical_tokens(F.col(name))).where(F.size(f"{side}_t") >= 2)
    keys = lambda side: [F.col(f"{side}_t")[k].alias(f"{side}_{k}") for k in (0, 1)]
    todo = tokens(todo, "name_norm", "e").select("entry_id", "e_t")
    bearers = tokens(narrators, "canonical_norm", "n").groupBy("n_t").agg(F.count("*").alias("k"), F.min("narrator_id").alias("id")).select("*", *keys("n"))
    names = todo.select("e_t").distinct().select("*", *keys("e"))
    size, exact = F.size("n_t"), F.col("e_t") == F.col("n_t")
    four = (size >= 4) & (F.slice("e_t", 1, 4) == F.slice("n_t", 1, 4))
    pairs = names.join(bearers, (F.col("e_0") == F.col("n_0")) & (F.col("e_1") == F.col("n_1"))).where((F.slice("e_t", F.lit(1), size) == F.col("n_t")) | four)
    got = pairs.groupBy("e_t").agg(F.coalesce(F.sum(F.when(exact, F.col("k"))), F.lit(0)).alias("exact"), F.sum("k").alias("candidates"), F.min(F.when(exact, F.col("id"))).alias("e"), F.min("id").alias("a"))
    one = F.when(F.col("exact") == 1, F.col("e")).when((F.col("exact") == 0) & (F.col("candidates") == 1), F.col("a"))
    many = (F.col("exact") > 1) | (F.col("exact") == 0) & (F.col("candidates") > 1)
    found = todo.join(got, "e_t").select("entry_id", one.alias("narrator_id"), many.alias("ambiguous"))
    if curated is None:
        return found
    return found.unionByName(curated.join(entries.select("entry_id"), "entry_id", "left_semi").select("entry_id", "narrator_id", F.lit(False).alias("ambiguous")))


@query("match_rijal_entries", "WITH n AS (SELECT canonical_norm, count(*) AS k, min(narrator_id) AS id FROM narrators GROUP BY 1) SELECT narrator_id + 1000000000 AS entry_id, CASE WHEN narrator_id % 50 = 7 THEN 1 WHEN k = 1 THEN id END AS narrator_id, k > 1 AND narrator_id % 50 <> 7 AS ambiguous FROM narrators JOIN n USING (canonical_norm) WHERE narrator_id % 50 <> 8")
def _(t):
    entries = t.narrators.select((F.col("narrator_id") + 1_000_000_000).alias("entry_id"), F.col("canonical_norm").alias("name_norm"))
    some = lambda k: entries.where((F.col("entry_id") - 1_000_000_000) % 50 == k).select("entry_id")
    return match_rijal_entries(t.narrators, entries, some(7).withColumn("narrator_id", F.lit(1).cast("long")), some(8))


def merge_enrichment(narrators: DataFrame, found: DataFrame, forced: bool = False) -> DataFrame:
    """Fields filled where they are null (or replaced, when ``forced``); of a map both sides' keys, with
    the narrator's own values (or the found ones, when ``forced``) where both have one."""
    fresh = found.select("narrator_id", *(F.col(c).alias(f"new_{c}") for c in found.columns if c != "narrator_id"))
    joined = narrators.join(fresh, "narrator_id", "left")

    def merged(c):
        first, second = (F.col(f"new_{c}"), F.col(c)) if forced else (F.col(c), F.col(f"new_{c}"))
        if not narrators.schema[c].dataType.simpleString().startswith("map"):
            return F.coalesce(first, second)
        rest = F.map_filter(second, lambda k, _: ~F.map_contains_key(first, k))
        return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(F.map_concat(first, rest))

    return joined.select(*(merged(c).alias(c) if c in found.columns and c != "narrator_id" else F.col(c) for c in narrators.columns))


@query("merge_enrichment", "SELECT narrator_id, coalesce(death_year_h, 150 + narrator_id % 3)::INT AS death_year_h, coalesce(generation, 'تابعي') AS generation, CASE WHEN narrator_id % 2 = 0 THEN 'own' ELSE 'found' END AS a, 'found' AS b FROM narrators")
def _(t):
    pairs = lambda v, *ks: F.create_map(*(x for k in ks for x in (F.lit(k), F.lit(v))))
    found = t.narrators.select("narrator_id", (F.col("narrator_id") % 3 + 150).cast("int").alias("death_year_h"), F.lit("تابعي").alias("generation"), pairs("found", "a", "b").alias("meta"))
    own = t.narrators.select("narrator_id", "death_year_h", "generation", F.when(F.col("narrator_id") % 2 == 0, pairs("own", "a")).alias("meta"))
    return merge_enrichment(own, found).select("narrator_id", "death_year_h", "generation", F.col("meta")["a"].alias("a"), F.col("meta")["b"].alias("b"))


def crosswalk_units(known: DataFrame, units: DataFrame) -> DataFrame:
    """For each unit (passage_id, work_id, num, text_norm) the best of (unit_id, work_id, num, unit_seq,
    unit_text) with the same number in the same work."""
    a = known.where(F.col("num").rlike("^[0-9]+$")).select("passage_id", "work_id", "num", words(F.col("text_norm")).alias("a"))
    b = units.select("unit_id", "unit_seq", "work_id", "num", words(F.left("unit_text", F.lit(800))).alias("b"))
    scored = a.join(b, ["work_id", "num"]).withColumn("confidence", F.round(ordered_token_hit(F.col("a"), F.col("b")), 4))
    best = Window.partitionBy("passage_id").orderBy(F.desc("confidence"), "unit_seq")
    return scored.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("passage_id", "unit_id", "unit_seq", "num", "confidence")


def crosswalk_sides(t):
    placed = t.passages.join(t.editions.select("edition_id", "work_id"), "edition_id").withColumn("num", F.expr("cast(try_cast(unit_num as int) % 200 as string)"))
    a = placed.where("edition_id % 2 = 0").select("passage_id", "work_id", "num", "text_norm").where("num is not null")
    b = placed.where("edition_id % 2 = 1").select(F.col("passage_id").alias("unit_id"), F.col("seq").alias("unit_seq"), "work_id", "num", F.col("text_norm").alias("unit_text")).where("num is not null")
    return a, b


CROSSWALK = """WITH p AS (SELECT passages.*, work_id, CAST(TRY_CAST(unit_num AS INT) % 200 AS VARCHAR) AS num FROM passages JOIN editions USING (edition_id)),
  c AS (SELECT a.passage_id, b.passage_id AS unit_id, b.seq AS unit_seq, a.num, list_filter(string_split(a.text_norm, ' '), lambda w: length(w) >= 3)[1:25] AS x, string_split(left(b.text_norm, 800), ' ') AS y FROM p a JOIN p b ON a.work_id = b.work_id AND a.num = b.num AND a.edition_id % 2 = 0 AND b.edition_id % 2 = 1),
  s AS (SELECT *, round(len(list_filter(x, lambda w: list_contains(y, w)))::DOUBLE / len(x), 4) AS confidence FROM c),
  m AS (SELECT passage_id, unit_id, unit_seq, num, confidence FROM (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY confidence DESC, unit_seq) AS rn FROM s) WHERE rn = 1)"""


@query("crosswalk_units", CROSSWALK + " SELECT * FROM m")
def _(t):
    return crosswalk_units(*crosswalk_sides(t))


@query("crosswalk_report", CROSSWALK + " SELECT count(*) AS matched, round(count(*)::DOUBLE / (SELECT count(*) FROM p WHERE edition_id % 2 = 0 AND num IS NOT NULL), 4) AS coverage, round(avg(confidence), 4) AS mean_confidence, round(avg(CASE WHEN confidence >= 0.6 THEN 1.0 ELSE 0 END), 4) AS high_share, count(DISTINCT num) AS numbers FROM m")
def _(t):
    a, b = crosswalk_sides(t)
    matched = crosswalk_units(a, b).agg(F.count("*").alias("matched"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.round(F.avg((F.col("confidence") >= 0.6).cast("double")), 4).alias("high_share"), F.countDistinct("num").alias("numbers"))
    return matched.crossJoin(a.agg(F.count("*").alias("all"))).select("matched", F.round(F.col("matched") / F.col("all"), 4).alias("coverage"), "mean_confidence", "high_share", "numbers")


@query("same_work_editions", "SELECT a.edition_id, b.edition_id AS other_id FROM editions a JOIN editions b USING (work_id) WHERE a.edition_id <> b.edition_id")
def _(t):
    other = t.editions.select("work_id", F.col("edition_id").alias("other_id"))
    return t.editions.select("work_id", "edition_id").join(other, "work_id").where("edition_id <> other_id").select("edition_id", "other_id")


@query("dual_source_works", "SELECT work_id, max(CASE WHEN source = 'units' THEN edition_id END) AS with_units, max(CASE WHEN source = 'pages' THEN edition_id END) AS with_pages FROM editions GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def _(t):
    of = lambda s: F.max(F.when(F.col("source") == s, F.col("edition_id"))).alias(f"with_{s}")
    return t.editions.groupBy("work_id").agg(of("units"), of("pages"), F.countDistinct("source").alias("k")).where("k >= 2").drop("k")


def near_token_sets(a: DataFrame, b: DataFrame, overlap: float, per_salt: int = 10_000, common: int = 4) -> DataFrame:
    """The token sets (w) of ``a`` that share at least ``overlap`` of the smaller set with one of ``b``.

    Exact, on hashes of tokens and numbers of sets; the sets themselves are fetched once, for pairs that
    are left.  Tokens that only one side has cannot be shared: of a smaller set of n tokens, r of them
    on the other side, ``needed`` of these r must be common, so of its r - needed + c rarest at least
    c are (c: ``common``, or what is needed).  These are joined with the tokens of sets that are not
    smaller, and pairs that share c of them are verified.  Tokens of more than ``per_salt`` sets are
    dealt over several keys."""
    both = a.select("w", F.lit(0).alias("side")).unionByName(b.select("w", F.lit(1).alias("side"))).where(F.size("w") > 0).distinct()
    sets = written(both.withColumn("sid", F.monotonically_increasing_id()), "sets")
    tokens = sets.select("sid", "side", F.size("w").alias("n"), F.explode(F.transform("w", lambda x: F.xxhash64(x))).alias("x"))
    counts = tokens.groupBy("x").agg(F.count_if(F.col("side") == 0).alias("c0"), F.count_if(F.col("side") == 1).alias("c1")).where("c0 > 0 and c1 > 0")
    # read from files, so that the join can split the rows of a token that very many sets have
    kept = tokens.join(shuffled(written(counts, "counts")), "x").groupBy("sid", "side", "n").agg(F.array_sort(F.collect_list(F.struct((F.col("c0") + F.col("c1")).alias("c"), "x", "c0", "c1"))).alias("t"))
    needed, r = F.ceil(F.col("n") * overlap - 1e-9).cast("int"), F.size("t")
    kept = written(kept.select("sid", "side", "n", "t", needed.alias("needed"), F.least(needed, F.lit(common)).alias("least")), "ordered")
    salts = lambda c: (c / per_salt).cast("int") + 1
    probes = kept.where(r >= F.col("needed")).select("sid", "side", "n", "least", F.explode(F.slice("t", F.lit(1), r - F.col("needed") + F.col("least"))).alias("t"))
    other = F.when(F.col("side") == 0, F.col("t.c1")).otherwise(F.col("t.c0"))  # as often as the other side has it
    probes = probes.select("side", F.col("sid").alias("small"), "n", "least", F.col("t.x").alias("x"), F.explode(F.sequence(F.lit(0), salts(other) - 1)).alias("salt"))
    own = F.when(F.col("side") == 0, F.col("t.c0")).otherwise(F.col("t.c1"))
    index = kept.select("sid", "side", "n", F.explode("t").alias("t"))
    index = index.select((1 - F.col("side")).alias("side"), F.col("sid").alias("large"), F.col("n").alias("m"), F.col("t.x").alias("x"), F.pmod(F.xxhash64("sid"), salts(own)).cast("int").alias("salt"))
    met = probes.join(shuffled(index), ["side", "x", "salt"]).where("n <= m").groupBy("side", "small", "large", "least").agg(F.count("*").alias("k")).where("k >= least")
    fetched = lambda name: sets.select(F.col("sid").alias(name), F.col("w").alias(f"{name}_w"))
    pairs = met.select("side", "small", "large").join(shuffled(fetched("small")), "small").join(shuffled(fetched("large")), "large").where(token_overlap(F.col("small_w"), F.col("large_w")) >= overlap)
    return pairs.select(F.when(F.col("side") == 0, F.col("small_w")).otherwise(F.col("large_w")).alias("w")).distinct()


def near_duplicate_gate(new: DataFrame, corpus: DataFrame, mapped: DataFrame, overlap: float = 0.9) -> DataFrame:
    """Units of ``new`` that are neither mapped, nor equal to a text of ``corpus``, nor share at least
    ``overlap`` of the tokens of the shorter of two texts with one, wherever these stand.  A text whose
    tokens another of its own work contains to that share is among those: the corpus holds all works,
    and the share of the new text is never above that of the shorter one."""
    left = new.join(shuffled(mapped.select("passage_id")), "passage_id", "left_anti").withColumn("h", F.xxhash64("text_norm"))
    left = left.join(shuffled(corpus.select(F.xxhash64("text_norm").alias("h")).distinct()), "h", "left_anti")
    tokens = F.array_sort(F.array_distinct(words(F.col("text_norm")))).alias("w")
    near = near_token_sets(left.select(tokens), corpus.select(tokens), overlap)
    return left.select("passage_id", tokens).join(shuffled(near), "w", "left_anti").select("passage_id")


@query("near_duplicate_gate")
def _(t):
    return near_duplicate_gate(t.passages.where("edition_id % 2 = 1").select("passage_id", "text_norm"), t.passages.where("edition_id % 2 = 0").select("text_norm"), t.chains.where("chain_id % 9 = 0").select("passage_id"))


def fragment_verify(pages: DataFrame, other: DataFrame, sample: int = 20, size: int = 30) -> DataFrame:
    """Per work the number of sampled ``pages`` (work_id, passage_id, text_norm) and of those whose middle
    letters occur in a text of ``other`` (work_id, text_norm).

    A work has ``sample`` fragments at most, so they go to the texts, in one array a work, and no text
    is paired with others."""
    letters = F.replace("text_norm", F.lit(" "), F.lit(""))
    middle = F.substring("body", F.greatest(F.floor(F.length("body") / 2) - size // 2, F.lit(1)).cast("int"), F.lit(size))
    drawn = Window.partitionBy("work_id").orderBy(F.md5(F.col("passage_id").cast("string")), "passage_id")
    asked = pages.withColumn("rn", F.row_number().over(drawn)).where(F.col("rn") <= sample).select("work_id", "passage_id", letters.alias("body")).select("work_id", "passage_id", middle.alias("fragment"))
    listed = asked.groupBy("work_id").agg(F.collect_list(F.struct("passage_id", "fragment")).alias("asked"))
    met = other.select("work_id", letters.alias("body")).join(listed, "work_id").select("work_id", F.explode(F.filter("asked", lambda a: F.col("body").contains(a["fragment"]))).alias("a"))
    found = met.select("work_id", "a.passage_id").distinct().groupBy("work_id").agg(F.count("*").alias("found"))
    return asked.groupBy("work_id").agg(F.count("*").alias("sampled")).join(found, "work_id", "left").fillna(0, ["found"])


@query("fragment_verify", "WITH p AS (SELECT work_id, edition_id, passage_id, replace(text_norm, ' ', '') AS body FROM passages JOIN editions USING (edition_id)), f AS (SELECT work_id, passage_id, substr(body, greatest(length(body) // 2 - 15, 1), 30) AS fragment FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY md5(passage_id::VARCHAR), passage_id) AS rn FROM p WHERE edition_id % 2 = 1) WHERE rn <= 20) SELECT work_id, count(*) AS sampled, count_if(EXISTS (SELECT 1 FROM p WHERE p.work_id = f.work_id AND p.edition_id % 2 = 0 AND contains(p.body, f.fragment))) AS found FROM f GROUP BY 1")
def _(t):
    rows = t.passages.join(t.editions.select("edition_id", "work_id"), "edition_id")
    return fragment_verify(rows.where("edition_id % 2 = 1"), rows.where("edition_id % 2 = 0"))


#: Fixed value: how a page's slug names a text of the live corpus.
PAGE_REFERENCE = r"bookid_(\d+)_.*?mainid_(\d+)_"


def page_refs(pages: DataFrame, matn: DataFrame, toc: DataFrame, books: DataFrame, pattern: str = PAGE_REFERENCE) -> DataFrame:
    """Pages (page_id, slug) that name a text of the corpus, with it: page_id, book_id, main_id, text_plain, title, name.

    The slug's ``pattern`` gives book and text; it is resolved in ``matn`` (book_id, main_id, text_plain),
    ``toc`` (book_id, node_id, title) and ``books`` (id, name).  What isn't in all three is left out."""
    number = lambda k: F.expr(f"try_cast(regexp_extract(slug, '{pattern.replace(chr(92), chr(92) * 2)}', {k}) as long)")
    refs = pages.select("page_id", number(1).alias("book_id"), number(2).alias("main_id")).where("book_id is not null and main_id is not null")
    found = refs.join(matn.select("book_id", "main_id", "text_plain"), ["book_id", "main_id"])
    found = found.join(toc.select("book_id", F.col("node_id").alias("main_id"), "title"), ["book_id", "main_id"])
    return found.join(books.select(F.col("id").alias("book_id"), "name"), "book_id").select("page_id", "book_id", "main_id", "text_plain", "title", "name")


@query("page_refs", """SELECT page_id, p.edition_id::BIGINT AS book_id, p.seq AS main_id, p.text_raw AS text_plain, concat('باب ', p.unit_num) AS title, e.title_ar AS name
  FROM pages g JOIN passages o ON o.passage_id = g.page_id JOIN passages p ON p.seq = o.seq AND p.edition_id = o.edition_id + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END
  JOIN editions e ON e.edition_id = p.edition_id WHERE p.kind = 'unit'""")
def _(t):
    """Slugs of the passages that have a page's number, every third with another book."""
    book = F.col("edition_id") + F.when(F.col("page_id") % 3 == 0, 1).otherwise(0)
    slug = F.concat(F.lit("viewpage_bookid_"), book, F.lit("_x_mainid_"), F.col("seq"), F.lit("_1"))
    pages = t.pages.join(t.passages, F.col("page_id") == F.col("passage_id")).select("page_id", slug.alias("slug"))
    matn = t.passages.select(F.col("edition_id").cast("long").alias("book_id"), F.col("seq").alias("main_id"), F.col("text_raw").alias("text_plain"))
    toc = t.passages.where("kind = 'unit'").select(F.col("edition_id").cast("long").alias("book_id"), F.col("seq").alias("node_id"), F.concat(F.lit("باب "), F.col("unit_num")).alias("title"))
    return page_refs(pages, matn, toc, t.editions.select(F.col("edition_id").cast("long").alias("id"), F.col("title_ar").alias("name")))


@query("name_bridge", "SELECT s_suppkey, work_id FROM (SELECT s_suppkey, lower(trim(concat('  كتاب  NATION_', s_nationkey))) AS n FROM supplier) JOIN works ON replace(n, '  ', ' ') = title_norm")
def _(t):
    from warraq.functions.arabic import normalize_arabic

    name = F.lower(normalize_arabic(F.concat(F.lit("  كتاب  NATION_"), F.col("s_nationkey"))))
    return t.supplier.select("s_suppkey", name.alias("title_norm")).join(t.works.select("work_id", "title_norm"), "title_norm").select("s_suppkey", "work_id")


def grams_of(words_: F.Column, sizes: list[int]) -> F.Column:
    """array<struct<size, start, gram>>: the runs of words of each size."""
    n = F.size(words_)
    runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.struct(F.lit(k).alias("size"), i.alias("start"), F.array_join(F.slice(words_, i, F.lit(k)), " ").alias("gram"))))
    return F.flatten(F.filter(F.array(*(runs(k) for k in sizes)), lambda x: x.isNotNull()))


def ground_mentions(questions: DataFrame, aliases: DataFrame, mentions: DataFrame, most: int = 4, top: int = 5) -> DataFrame:
    """Narrators whose alias is a 1- to ``most``-gram of a question, as it stands or in canonical form (one
    form of 'son', one case of 'father of'), the most mentioned first.

    Of the narrators of one alias only the ``top`` most mentioned can be among a question's, so a question
    meets no more, however many share a name."""
    told = once(questions.select("question_id", "text"), own=words(F.col("text")), other=canonical_tokens(F.col("text")))
    both = F.array_union(*(F.transform(grams_of(F.col(c), range(1, most + 1)), lambda g: g["gram"]) for c in ("own", "other")))
    grams = told.select("question_id", F.explode(F.array_distinct(both)).alias("alias_norm"))
    first = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("mentions"), "narrator_id"))
    named = aliases.select("alias_norm", "narrator_id").distinct().join(shuffled(mentions), "narrator_id", "left").fillna(0, ["mentions"])
    named = named.withColumn("rank", first("alias_norm")).where(F.col("rank") <= top).drop("rank")
    listed = few(written(named.groupBy("alias_norm").agg(F.collect_list(F.struct("narrator_id", "mentions")).alias("of")), "named"))
    found = grams.join(listed, "alias_norm").select("question_id", F.explode("of").alias("n")).select("question_id", "n.*")
    found = found.repartition("question_id").distinct()  # both steps by one exchange
    return found.withColumn("rank", first("question_id")).where(F.col("rank") <= top).select("question_id", "narrator_id", "mentions", "rank")


def ground_frames(questions: DataFrame, aliases: DataFrame, stop_words: list[str] = (), sizes: tuple[int, ...] = (4, 3, 2), top: int = 3) -> DataFrame:
    """The mentions (question_id, start, mention, candidates) of narrators in a question: spans that are
    an alias, longer ones first, then earlier ones, none that overlaps one before; ``top`` candidates
    each, the lowest ids.  Spans of stop words alone are no mentions."""
    lowest = Window.partitionBy("alias_norm").orderBy("narrator_id")
    named = aliases.select("alias_norm", "narrator_id").distinct().withColumn("rn", F.row_number().over(lowest)).where(F.col("rn") <= top)
    named = named.groupBy("alias_norm").agg(F.array_sort(F.collect_list("narrator_id")).alias("candidates"))
    grams = questions.select("question_id", F.explode(grams_of(words(F.col("text")), list(sizes))).alias("g"))
    grams = grams.where(F.exists(F.split("g.gram", " "), lambda w: ~w.isin(*stop_words))) if stop_words else grams
    found = grams.select("question_id", "g.*").join(named, F.col("gram") == F.col("alias_norm"))
    spans = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "start", "size", F.col("gram").alias("mention"), "candidates")))
    overlap = lambda a, b: (a["start"] < b["start"] + b["size"]) & (b["start"] < a["start"] + a["size"])
    listed = found.groupBy("question_id").agg(spans.alias("spans"))
    kept = F.aggregate("spans", F.slice("spans", 1, 0), lambda s, x: F.when(F.exists(s, lambda y: overlap(x, y)), s).otherwise(F.concat(s, F.array(x))))
    return listed.select("question_id", F.explode(kept).alias("s")).select("question_id", (F.col("s.start") - 1).alias("start"), "s.mention", "s.candidates")


def asked(t) -> DataFrame:
    """The stated query set: every twentieth chain's text is a question."""
    return t.chain_texts.where("chain_id % 20 = 0").select(F.col("chain_id").alias("question_id"), F.col("sanad").alias("text"))


@query("ground_mentions", "WITH m AS (SELECT narrator_id, count(*) AS mentions FROM links WHERE narrator_id IS NOT NULL GROUP BY 1), q AS (SELECT DISTINCT chain_id AS question_id, mention_norm FROM links WHERE chain_id % 20 = 0), f AS (SELECT question_id, n.narrator_id, coalesce(mentions, 0) AS mentions FROM q JOIN narrators n ON n.canonical_norm = q.mention_norm LEFT JOIN m USING (narrator_id)) SELECT question_id, narrator_id, mentions, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY mentions DESC, narrator_id)::INT AS rank FROM f) WHERE rank <= 5")
def _(t):
    mentions = t.links.where("narrator_id is not null").groupBy("narrator_id").agg(F.count("*").alias("mentions"))
    variants = asked(t).withColumn("text", F.replace("text", F.lit(" بن "), F.lit(" ابن ")))
    return ground_mentions(variants, t.narrators.select("narrator_id", F.col("canonical_norm").alias("alias_norm")), mentions)


@query("ground_frames", "SELECT chain_id AS question_id, (row_number() OVER (PARTITION BY chain_id ORDER BY pos) - 1)::INT * 4 + 1 AS start, mention_norm AS mention, ids[1:3] AS candidates FROM links JOIN (SELECT canonical_norm, list(narrator_id ORDER BY narrator_id) AS ids FROM narrators GROUP BY 1) n ON n.canonical_norm = mention_norm WHERE chain_id % 20 = 0")
def _(t):
    return ground_frames(asked(t), t.narrators.select("narrator_id", F.col("canonical_norm").alias("alias_norm")), ["عن", "بن"])
