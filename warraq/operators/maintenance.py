"""Batch rewrites: merging, deleting and removing with everything that depends on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.functions.text import words
from warraq.registry import query


def repointed(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``column`` with each source id replaced by its target."""
    m = mapping.select(F.col("source_id").alias(column), F.col("target_id").alias("_to"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def merge_entities(mapping: DataFrame, narrators: DataFrame, links: DataFrame, aliases: DataFrame, edges: DataFrame, assessments: DataFrame | None = None) -> dict[str, DataFrame]:
    """``mapping`` (source_id, target_id, ord): links, assessments, aliases and edges point to the targets,
    source names become aliases, edges lose self loops and repeats, and targets take what they lack
    from their sources in order: fields that are null, and keys that their map ``meta`` hasn't."""
    names = narrators.join(mapping.select(F.col("source_id").alias("narrator_id"), "target_id"), "narrator_id").select(F.col("target_id").alias("narrator_id"), F.col("canonical_norm").alias("alias_norm"), F.lit("merged").alias("alias_kind"))
    every = repointed(aliases, mapping, "narrator_id").unionByName(names).dropDuplicates(["narrator_id", "alias_norm", "alias_kind"])
    moved = repointed(repointed(edges, mapping, "student"), mapping, "teacher").where("student <> teacher").groupBy("student", "teacher").agg(F.max("weight").alias("weight"))
    sources = narrators.join(mapping.select(F.col("source_id").alias("narrator_id"), "target_id", "ord"), "narrator_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"_{c}")
    fields = [c for c in narrators.columns if c not in ("narrator_id", "canonical_ar", "canonical_norm", "meta")]
    gathered = [F.array_sort(F.collect_set("narrator_id")).alias("merged_ids"), F.array_sort(F.collect_set("canonical_ar")).alias("merged_names")]
    if "meta" in narrators.columns:
        # the earliest source's value of each key: maps are put together from the last to the first
        listed = F.array_sort(F.collect_list(F.when(F.col("meta").isNotNull(), F.struct((-F.col("ord")).alias("o"), F.map_entries("meta").alias("m")))))
        keys = F.array_distinct(F.flatten(F.transform(listed, lambda x: F.transform(x["m"], lambda e: e["key"]))))
        value = lambda k: F.element_at(F.filter(F.flatten(F.transform(listed, lambda x: x["m"])), lambda e: e["key"] == k), -1)["value"]
        gathered.append(F.map_from_arrays(keys, F.transform(keys, value)).alias("_meta"))
    filled = sources.groupBy(F.col("target_id").alias("narrator_id")).agg(*(first(c) for c in fields), *gathered)
    kept = narrators.join(mapping.select(F.col("source_id").alias("narrator_id")), "narrator_id", "left_anti").join(filled, "narrator_id", "left")
    meta = F.when(F.col("_meta").isNull(), F.col("meta")).when(F.col("meta").isNull(), F.col("_meta")).otherwise(F.map_concat("meta", F.map_filter("_meta", lambda k, _: ~F.map_contains_key("meta", k)))) if "meta" in narrators.columns else None
    kept = kept.select(*(F.coalesce(c, f"_{c}").alias(c) if c in fields else meta.alias(c) if c == "meta" else F.col(c) for c in narrators.columns), "merged_ids", "merged_names")
    out = {"narrators": kept, "links": repointed(links, mapping, "narrator_id"), "aliases": every, "edges": moved}
    return out | ({"assessments": repointed(assessments, mapping, "narrator_id")} if assessments is not None else {})


def merge_inputs(t):
    """Every narrator with an odd id below 40 goes to the one before it."""
    mapping = t.narrators.where("narrator_id < 40 and narrator_id % 2 = 1").select(F.col("narrator_id").alias("source_id"), (F.col("narrator_id") - 1).alias("target_id"), F.col("narrator_id").alias("ord"))
    from warraq.operators.graph import edges

    aliases = t.narrators.select("narrator_id", F.col("canonical_norm").alias("alias_norm"), F.lit("name").alias("alias_kind"))
    return merge_entities(mapping, t.narrators.select("narrator_id", "canonical_ar", "canonical_norm", "death_year_h", "generation"), t.links.where("narrator_id is not null").select("chain_id", "pos", "narrator_id"), aliases, edges(t.links))


TO = "CASE WHEN {0} < 40 AND {0} % 2 = 1 THEN {0} - 1 ELSE {0} END"


@query("merge_entities", f"SELECT chain_id, pos, {TO.format('narrator_id')} AS narrator_id FROM links WHERE narrator_id IS NOT NULL")
def _(t):
    return merge_inputs(t)["links"]


@query("merge_entities_fields", "SELECT n.narrator_id, coalesce(n.death_year_h, s.death_year_h) AS death_year_h, coalesce(n.generation, s.generation) AS generation FROM narrators n LEFT JOIN narrators s ON s.narrator_id = n.narrator_id + 1 AND n.narrator_id < 40 WHERE NOT (n.narrator_id < 40 AND n.narrator_id % 2 = 1)")
def _(t):
    return merge_inputs(t)["narrators"].select("narrator_id", "death_year_h", "generation")


@query("merge_entities_meta", "SELECT n.narrator_id, coalesce(CASE WHEN n.narrator_id % 4 = 0 THEN 'own' END, CASE WHEN s.narrator_id IS NOT NULL THEN 'source' END) AS a, CASE WHEN s.narrator_id IS NOT NULL THEN concat('b', s.narrator_id) END AS b, (SELECT count(*) FROM narrators x WHERE x.narrator_id = n.narrator_id OR x.narrator_id = s.narrator_id) AS assessments FROM narrators n LEFT JOIN narrators s ON s.narrator_id = n.narrator_id + 1 AND n.narrator_id < 40 AND n.narrator_id % 2 = 0 WHERE NOT (n.narrator_id < 40 AND n.narrator_id % 2 = 1)")
def _(t):
    """What merged narrators take over of the sources' maps, and their assessments."""
    k = F.col("narrator_id")
    mapping = t.narrators.where("narrator_id < 40 and narrator_id % 2 = 1").select(k.alias("source_id"), (k - 1).alias("target_id"), k.alias("ord"))
    odd = (k < 40) & (k % 2 == 1)
    meta = F.when(odd, F.create_map(F.lit("a"), F.lit("source"), F.lit("b"), F.concat(F.lit("b"), k))).when(k % 4 == 0, F.create_map(F.lit("a"), F.lit("own")))
    rows = t.narrators.select("narrator_id", "canonical_ar", "canonical_norm", meta.alias("meta"))
    none = t.narrators.limit(0)
    edges = none.select(k.alias("student"), k.alias("teacher"), F.lit(1).alias("weight"))
    merged = merge_entities(mapping, rows, none.select("narrator_id"), none.select("narrator_id", F.col("canonical_norm").alias("alias_norm"), F.lit("n").alias("alias_kind")), edges, rows.select("narrator_id"))
    counted = merged["assessments"].groupBy("narrator_id").agg(F.count("*").alias("assessments"))
    return merged["narrators"].join(counted, "narrator_id").select("narrator_id", F.col("meta")["a"].alias("a"), F.col("meta")["b"].alias("b"), "assessments")


@query("merge_entities_edges", f"WITH e AS (SELECT student, teacher, count(*) AS weight FROM (SELECT pos, narrator_id AS student, lead(pos) OVER w AS np, lead(narrator_id) OVER w AS teacher FROM links WINDOW w AS (PARTITION BY chain_id ORDER BY pos)) WHERE np = pos + 1 AND student IS NOT NULL AND teacher IS NOT NULL AND student <> teacher GROUP BY 1, 2), m AS (SELECT {TO.format('student')} AS student, {TO.format('teacher')} AS teacher, weight FROM e) SELECT student, teacher, max(weight) AS weight FROM m WHERE student <> teacher GROUP BY 1, 2")
def _(t):
    return merge_inputs(t)["edges"]


@query("merge_entities_aliases", f"SELECT DISTINCT {TO.format('narrator_id')} AS narrator_id, canonical_norm AS alias_norm, 'name' AS alias_kind FROM narrators UNION SELECT narrator_id - 1, canonical_norm, 'merged' FROM narrators WHERE narrator_id < 40 AND narrator_id % 2 = 1")
def _(t):
    return merge_inputs(t)["aliases"]


def find_name_variants(narrators: DataFrame, mentions: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Narrators named ``key`` with nothing but allowed words after it, and the most mentioned as target."""
    tokens = F.filter(words(F.regexp_replace("canonical_norm", "[^ء-ي ]", "")), lambda w: w != "")
    head = key.split()
    rest = F.slice("w", F.lit(len(head) + 1), F.greatest(F.size("w") - len(head), F.lit(0)))
    same = (F.slice("w", 1, len(head)) == F.array(*(F.lit(h) for h in head))) & F.forall(rest, lambda w: w.isin(allowed))
    found = narrators.select("narrator_id", tokens.alias("w")).where(F.size("w") >= len(head)).where(same).join(mentions, "narrator_id", "left").fillna(0, ["mentions"])
    most = found.agg(F.max_by("narrator_id", F.struct("mentions", -F.col("narrator_id"))).alias("target_id"))  # one row
    return found.crossJoin(most).select("narrator_id", "target_id")


@query("find_name_variants", "WITH f AS (SELECT n.narrator_id, count(l.chain_id) AS mentions FROM narrators n LEFT JOIN links l USING (narrator_id) WHERE canonical_norm IN ('مالك بن انس', 'مالك بن عمر', 'مالك بن دينار') GROUP BY 1) SELECT narrator_id, (SELECT narrator_id FROM f ORDER BY mentions DESC, narrator_id LIMIT 1) AS target_id FROM f")
def _(t):
    mentions = t.links.where("narrator_id is not null").groupBy("narrator_id").agg(F.count("*").alias("mentions"))
    return find_name_variants(t.narrators, mentions, "مالك بن", ["انس", "عمر", "دينار"])


def delete_entity(gone: DataFrame, narrators: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(narrators, links) without the narrators of ``gone`` (narrator_id): their links stay, unresolved."""
    gone = gone.select("narrator_id").distinct()
    marked = links.join(gone.withColumn("_gone", F.lit(True)), "narrator_id", "left")
    unresolved = marked.withColumn("narrator_id", F.when(F.col("_gone").isNull(), F.col("narrator_id")))
    return narrators.join(gone, "narrator_id", "left_anti"), unresolved.select(links.columns)


@query("delete_entity", "SELECT 'link' AS kind, chain_id, pos, CASE WHEN narrator_id IN (3, 4) THEN NULL ELSE narrator_id END AS narrator_id FROM links UNION ALL SELECT 'narrator', NULL, NULL, narrator_id FROM narrators WHERE narrator_id NOT IN (3, 4)")
def _(t):
    left, links = delete_entity(t.narrators.where("narrator_id in (3, 4)"), t.narrators, t.links)
    return links.select(F.lit("link").alias("kind"), "chain_id", "pos", "narrator_id").unionByName(left.select(F.lit("narrator").alias("kind"), "narrator_id"), allowMissingColumns=True)


def remove_edition_cascade(edition: int, editions: DataFrame, passages: DataFrame, dependents: dict[str, DataFrame], source: str, most: int, works: DataFrame | None = None) -> dict[str, DataFrame]:
    """What is left of each table without the edition, and of works without those that no edition is
    left of; nothing goes if the edition's source or size isn't as said.  Tables depend by passage_id, or,
    without that column, by edition_id."""
    doomed = passages.where(F.col("edition_id") == edition).select("passage_id")
    found = editions.where((F.col("edition_id") == edition) & (F.col("source") == source)).count()
    if not found or doomed.count() > most:
        raise ValueError("the edition isn't the one that was meant")
    of = lambda df: df.join(doomed, "passage_id", "left_anti") if "passage_id" in df.columns else df.where(F.col("edition_id") != edition)
    left = {name: of(df) for name, df in ({"passages": passages} | dependents).items()}
    left["editions"] = editions.where(F.col("edition_id") != edition)
    if works is not None:
        gone = editions.where(F.col("edition_id") == edition).select("work_id").join(left["editions"].select("work_id"), "work_id", "left_anti")
        left["works"] = works.join(gone, "work_id", "left_anti")
    return left


@query("remove_edition_cascade", "SELECT 'passages' AS name, (SELECT count(*) FROM passages WHERE edition_id = 4) AS removed UNION ALL SELECT 'chains', (SELECT count(*) FROM chains JOIN passages USING (passage_id) WHERE edition_id = 4) UNION ALL SELECT 'grades', (SELECT count(*) FROM grades JOIN passages USING (passage_id) WHERE edition_id = 4) UNION ALL SELECT 'editions', 1 UNION ALL SELECT 'works', 0 UNION ALL SELECT 'works of one edition', 1 UNION ALL SELECT 'toc', (SELECT count(*) FROM toc WHERE edition_id = 4)")
def _(t):
    tables = {"chains": t.chains, "grades": t.grades, "toc": t.toc}
    left = remove_edition_cascade(4, t.editions, t.passages, tables, "units", 10**9, t.works)
    alone = remove_edition_cascade(4, t.editions.where("edition_id <> 5"), t.passages, {}, "units", 10**9, t.works)
    pairs = {name: (df, left[name]) for name, df in ({"passages": t.passages, "editions": t.editions, "works": t.works} | tables).items()} | {"works of one edition": (t.works, alone["works"])}
    parts = None
    for name, (before, after) in pairs.items():
        row = before.agg(F.count("*").alias("a")).crossJoin(after.agg(F.count("*").alias("b"))).select(F.lit(name).alias("name"), (F.col("a") - F.col("b")).alias("removed"))
        parts = row if parts is None else parts.unionByName(row)
    return parts
