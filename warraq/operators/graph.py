"""Student-teacher graph over chain links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warraq.functions.arabic import normalize_arabic
from warraq.functions.text import canonical_tokens
from warraq.registry import query
from warraq.sources.folders import written


def consecutive_pairs(links: DataFrame, same: bool = False) -> DataFrame:
    """(chain_id, student, teacher) of neighbours without a position gap, both resolved and different
    (or, with ``same``, perhaps the same).

    ``lead`` runs over all links of a chain before unresolved ones go, in one shuffle."""
    following = Window.partitionBy("chain_id").orderBy("pos")
    ahead = links.select("chain_id", "pos", F.col("narrator_id").alias("student"), F.lead("pos").over(following).alias("next_pos"), F.lead("narrator_id").over(following).alias("teacher"))
    return ahead.where("next_pos = pos + 1 and student is not null and teacher is not null" + ("" if same else " and student <> teacher")).select("chain_id", "student", "teacher")


def edges(links: DataFrame) -> DataFrame:
    return consecutive_pairs(links).groupBy("student", "teacher").agg(F.count("*").alias("weight"))


def top_pairs(links: DataFrame, narrators: DataFrame, n: int = 50, offset: int = 0) -> DataFrame:
    name = lambda role: narrators.select(F.col("narrator_id").alias(role), F.col("canonical_ar").alias(f"{role}_name"))
    top = edges(links).orderBy(F.desc("weight"), "student", "teacher").offset(offset).limit(n)
    return top.join(name("student"), "student", "left").join(name("teacher"), "teacher", "left").select("student", "student_name", "teacher", "teacher_name", "weight")


def graph_nodes_edges(links: DataFrame, mentions: int = 5, weight: int = 2) -> DataFrame:
    nodes = links.where("narrator_id is not null").groupBy("narrator_id").agg(F.count("*").alias("n")).where(F.col("n") >= mentions).select("narrator_id")
    strong = edges(links).where(F.col("weight") >= weight)
    return strong.join(nodes, strong.student == nodes.narrator_id, "left_semi").join(nodes, strong.teacher == nodes.narrator_id, "left_semi")


def apply_manual_edges(derived: DataFrame, manual: DataFrame) -> DataFrame:
    """Derived and added edges summed, without the removed ones."""
    added = manual.where("action = 'add'").select("student", "teacher", "weight")
    removed = manual.where("action = 'remove'").select("student", "teacher")
    return derived.select("student", "teacher", "weight").unionByName(added).groupBy("student", "teacher").agg(F.sum("weight").alias("weight")).join(removed, ["student", "teacher"], "left_anti")


SUBGRAPH = "start long, seen array<long>, frontier array<long>, taken array<struct<student: long, teacher: long, weight: long>>"


def _hop(cap: int):
    """The state of one start after the edges found for its frontier, which come in their order."""

    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        if not state.num_rows:
            return state
        row = state.to_pylist()[0]
        seen, frontier = set(row["seen"]), []
        taken = {(e["student"], e["teacher"]): e["weight"] for e in row["taken"]}
        for e in found.sort_by("rank").to_pylist():
            ends = dict.fromkeys(n for n in (e["student"], e["teacher"]) if n not in seen)
            if ends and len(seen) >= cap:
                continue
            seen |= set(ends)
            frontier += ends
            taken[e["student"], e["teacher"]] = e["weight"]
        listed = [{"student": s, "teacher": t, "weight": w} for (s, t), w in taken.items()]
        out = {"start": row["start"], "seen": sorted(seen), "frontier": frontier, "taken": listed}
        return pa.Table.from_pylist([out], schema=state.schema)

    return run


def bounded_subgraph(graph: DataFrame, starts: DataFrame, hops: int = 3, cap: int = 300) -> DataFrame:
    """Edges (start, student, teacher, weight) reached within ``hops`` of each of ``starts`` (start), in
    either direction, heaviest first, among ``cap`` nodes; a start that has its nodes goes no further.

    What a start has seen, taken and not yet left is a row of a written table, and bounded by ``cap``.
    A hop joins all frontiers with the heaviest 3 * cap edges of each node, which are all that a
    frontier can take of it, so a node with very many edges is as cheap as any other."""
    order = [F.desc("weight"), F.col("student"), F.col("teacher")]
    of = lambda end: graph.select(F.col(end).alias("node"), "student", "teacher", "weight")
    both = of("student").unionByName(of("teacher").where("student <> teacher"))
    most = F.row_number().over(Window.partitionBy("node").orderBy(*order))
    heaviest = written(both.withColumn("rank", most).where(F.col("rank") <= 3 * cap).drop("rank"), "heaviest")
    own = F.array("start")
    first = starts.select(F.col("start").cast("long").alias("start")).distinct().select("start", own.alias("seen"), own.alias("frontier"), F.array().alias("taken"))
    state = written(graph.sparkSession.createDataFrame([], SUBGRAPH).unionByName(first), "subgraph")
    for _ in range(hops):
        able = (F.size("frontier") > 0) & (F.size("seen") < cap)
        going = state.where(able)
        if going.isEmpty():
            break
        asked = going.select("start", F.explode("frontier").alias("node"))
        found = asked.join(heaviest, "node").drop("node").distinct()
        rank = F.row_number().over(Window.partitionBy("start").orderBy(*order))
        found = found.withColumn("rank", rank).where(F.col("rank") <= 3 * cap)
        moved = going.groupBy("start").cogroup(found.withColumnRenamed("start", "of").groupBy("of")).applyInArrow(_hop(cap), SUBGRAPH)
        state = written(state.where(~able).unionByName(moved), "subgraph")
    return state.select("start", F.inline("taken"))


def expand_nodes(graph: DataFrame, nodes: list[int], cap: int = 300) -> DataFrame:
    return graph.where(F.col("student").isin(nodes) | F.col("teacher").isin(nodes)).orderBy(F.desc("weight"), "student", "teacher").limit(cap)


def kin_relation(student: F.Column, teacher: F.Column, student_class: F.Column | None = None, teacher_class: F.Column | None = None) -> F.Column:
    """Family relation by the words of two names: the teacher's name goes on as the student's does after
    the first 'son of' (father) or the second (grandfather), as far as both go; both names go on
    alike for two words or more after different first names (brother); the classes are the same
    (peer); else teacher."""
    s, t = canonical_tokens(normalize_arabic(student)), canonical_tokens(normalize_arabic(teacher))
    of = lambda w: F.transform(w, lambda x: x.isin("بن", "بنت"))
    first = lambda w: F.array_position(of(w), True)
    after = lambda w, at: F.slice(w, (at + 1).cast("int"), F.size(w))
    one = first(s)
    next_ = F.array_position(after(of(s), one), True)
    two = F.when((one > 0) & (next_ > 0), one + next_).otherwise(0)

    def goes_on(at):
        rest = after(s, at)
        n = F.least(F.size(rest), F.size(t))
        return F.coalesce((at > 0) & (n > 0) & (F.slice(rest, F.lit(1), n) == F.slice(t, F.lit(1), n)), F.lit(False))

    tail = lambda w: F.slice(w, F.greatest(first(w), F.lit(1)).cast("int"), F.lit(4))
    head = lambda w: F.slice(w, F.lit(1), F.greatest(first(w) - 1, F.lit(0)).cast("int"))
    siblings = (one > 0) & (first(t) > 0) & (head(s) != head(t)) & (tail(s) == tail(t)) & (F.size(tail(s)) >= 2)
    out = F.when(goes_on(one), "father").when(goes_on(two), "grandfather").when(F.coalesce(siblings, F.lit(False)), "brother")
    if student_class is not None:
        out = out.when((F.size(s) > 0) & (F.size(t) > 0) & (student_class != 0) & (student_class == teacher_class), "peer")
    return out.otherwise("teacher")


def edge_relations(graph: DataFrame, narrators: DataFrame) -> DataFrame:
    """Each edge (student, teacher) with the relation by ``narrators`` (narrator_id, canonical_norm, tabaqa)."""
    name = lambda role: narrators.select(F.col("narrator_id").alias(role), F.col("canonical_norm").alias(f"{role}_name"), F.col("tabaqa").alias(f"{role}_class"))
    named = graph.join(name("student"), "student").join(name("teacher"), "teacher")
    return named.select("student", "teacher", kin_relation(*(F.col(f"{role}_{x}") for x in ("name", "class") for role in ("student", "teacher"))).alias("relation"))


def parents_of(nodes: DataFrame) -> DataFrame:
    """(node_id, parent_id) of the nodes that have a parent among ``nodes`` (node_id, parent_id), without
    cycles: a cycle is cut above its smallest node, which is a root then, and what leads into the
    cycle hangs below it as it did.  A missing or negative parent makes a root too.

    Cycles are found by pointer doubling: round k knows who is 2 ** k steps above a node, and the
    smallest node on the way.  Nodes with an end above them leave; when a round loses none, those that
    are left lead into cycles, and once a jump is as long as there are nodes left it ends on one."""
    known = nodes.select(F.col("node_id").alias("parent_id")).distinct()
    up = nodes.where("parent_id >= 0").join(known, "parent_id", "left_semi").select("node_id", "parent_id")
    live = written(up.select("node_id", F.col("parent_id").alias("jump"), F.col("node_id").alias("least")), "jumps")
    left, reach, closed = live.count(), 1, False
    while left and not (closed and reach >= left):
        ahead = live.select(F.col("node_id").alias("jump"), F.col("jump").alias("next"), F.col("least").alias("low"))
        live = written(live.join(ahead, "jump").select("node_id", F.col("next").alias("jump"), F.least("least", "low").alias("least")), "jumps")
        before, left, reach = left, live.count(), 2 * reach
        closed = closed or left == before
    if not left:
        return up
    circling = live.select(F.col("jump").alias("node_id")).distinct()
    cut = live.where("least = node_id").join(circling, "node_id", "left_semi").select("node_id")
    return up.join(cut, "node_id", "left_anti")


def tree_depth(nodes: DataFrame) -> DataFrame:
    """(node_id, depth): steps to the root (see ``parents_of`` for cycles), in as many rounds as the
    logarithm of the depth: each round doubles how far a node looks.  Rounds are written tables."""
    up = parents_of(nodes).select("node_id", F.col("parent_id").alias("jump"))
    state = nodes.select("node_id").distinct().join(up, "node_id", "left").withColumn("depth", F.col("jump").isNotNull().cast("int"))
    while True:
        state = written(state, "depths")
        live = state.where("jump is not null")
        if live.isEmpty():
            return state.select("node_id", "depth")
        ahead = state.select(F.col("node_id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"))
        moved = live.join(ahead, "jump").select("node_id", F.col("next").alias("jump"), (F.col("depth") + F.col("more")).alias("depth"))
        state = state.where("jump is null").unionByName(moved)


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, up) for each node and all above it, itself included (see ``parents_of`` for
    cycles).

    Pointer doubling: round k adds those from 2 ** k to 2 ** (k + 1) - 1 steps above a node, which
    are what the node 2 ** k above it has so far; rounds are as many as the logarithm of the depth."""
    jump, k = parents_of(nodes).select("node_id", F.col("parent_id").alias("jump")), 0
    so_far = written(nodes.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("up")).distinct(), "ancestors")
    while True:
        jump = written(jump, "jumps")
        if jump.isEmpty():
            return so_far
        above = so_far.select(F.col("node_id").alias("jump"), "ancestor_id", "up")
        more = jump.join(above, "jump").select("node_id", "ancestor_id", (F.col("up") + (1 << k)).alias("up"))
        so_far = so_far.unionByName(written(more, "ancestors"))
        jump = jump.join(jump.select(F.col("node_id").alias("jump"), F.col("jump").alias("next")), "jump").select("node_id", F.col("next").alias("jump"))
        k += 1


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    titled = ancestors(nodes).join(nodes.select(F.col("node_id").alias("ancestor_id"), "title"), "ancestor_id")
    path = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("o"), "title")))
    return titled.groupBy("node_id").agg(F.array_join(F.transform(path, lambda x: x["title"]), " > ").alias("path"))


EDGES = "SELECT student, teacher, count(*) AS weight FROM (SELECT chain_id, pos, narrator_id AS student, lead(pos) OVER w AS np, lead(narrator_id) OVER w AS teacher FROM links WINDOW w AS (PARTITION BY chain_id ORDER BY pos)) WHERE np = pos + 1 AND student IS NOT NULL AND teacher IS NOT NULL AND student <> teacher GROUP BY 1, 2"
PAIRS = EDGES.replace("student, teacher, count(*) AS weight", "chain_id, student, teacher").replace(" GROUP BY 1, 2", "")


@query("consecutive_pairs", "SELECT a.chain_id, a.narrator_id AS student, b.narrator_id AS teacher FROM links a JOIN links b ON a.chain_id = b.chain_id AND b.pos = a.pos + 1 WHERE a.narrator_id <> b.narrator_id")
def _(t):
    return consecutive_pairs(t.links)


@query("top_pairs", f"WITH e AS ({EDGES}) SELECT student, s.canonical_ar AS student_name, teacher, x.canonical_ar AS teacher_name, weight FROM (SELECT * FROM e ORDER BY weight DESC, student, teacher LIMIT 50) LEFT JOIN narrators s ON s.narrator_id = student LEFT JOIN narrators x ON x.narrator_id = teacher")
def _(t):
    return top_pairs(t.links, t.narrators)


@query("graph_nodes_edges", f"WITH e AS ({EDGES}), n AS (SELECT narrator_id FROM links WHERE narrator_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) SELECT * FROM e WHERE weight >= 2 AND student IN (FROM n) AND teacher IN (FROM n)")
def _(t):
    return graph_nodes_edges(t.links)


MANUAL = "SELECT s_suppkey AS student, (s_suppkey + 1) % 100 AS teacher, CASE WHEN s_suppkey % 3 = 0 THEN 'remove' ELSE 'add' END AS action, CAST(3 AS BIGINT) AS weight FROM supplier"


@query("apply_manual_edges", f"WITH e AS ({EDGES}), m AS ({MANUAL}) SELECT student, teacher, sum(weight)::BIGINT AS weight FROM (SELECT * FROM e UNION ALL SELECT student, teacher, weight FROM m WHERE action = 'add') WHERE (student, teacher) NOT IN (SELECT student, teacher FROM m WHERE action = 'remove') GROUP BY 1, 2")
def edges_with_manual(t):
    manual = t.supplier.select(F.col("s_suppkey").alias("student"), ((F.col("s_suppkey") + 1) % 100).alias("teacher"), F.when(F.col("s_suppkey") % 3 == 0, "remove").otherwise("add").alias("action"), F.lit(3).cast("long").alias("weight"))
    return apply_manual_edges(edges(t.links), manual)


@query("edges_union", f"WITH e AS ({EDGES}), m AS ({MANUAL}) SELECT student, teacher, weight, 'derived' AS origin FROM e UNION ALL SELECT student, teacher, weight, 'manual' FROM m WHERE action = 'add'")
def _(t):
    manual = t.supplier.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("student"), ((F.col("s_suppkey") + 1) % 100).alias("teacher"), F.lit(3).cast("long").alias("weight"), F.lit("manual").alias("origin"))
    return edges(t.links).withColumn("origin", F.lit("derived")).unionByName(manual)


@query("bounded_subgraph")
def _(t):
    """Around every narrator."""
    return bounded_subgraph(edges(t.links), t.narrators.select(F.col("narrator_id").alias("start")), hops=2, cap=40)


@query("expand_nodes", f"WITH e AS ({EDGES}) SELECT * FROM e WHERE student IN (1, 2, 3) OR teacher IN (1, 2, 3) ORDER BY weight DESC, student, teacher LIMIT 300")
def _(t):
    return expand_nodes(edges(t.links), [1, 2, 3])


RELATIONS = f"""WITH e AS ({EDGES}), n AS (SELECT narrator_id, split_part(canonical_norm, ' بن ', 1) AS own, split_part(canonical_norm, ' بن ', 2) AS father, narrator_id % 12 AS tabaqa FROM narrators)
  SELECT student, teacher, CASE WHEN starts_with(concat(t.own, ' '), concat(s.father, ' ')) THEN 'father' WHEN s.own <> t.own AND s.father = t.father THEN 'brother' WHEN s.tabaqa <> 0 AND s.tabaqa = t.tabaqa THEN 'peer' ELSE 'teacher' END AS relation
  FROM e JOIN n s ON s.narrator_id = student JOIN n t ON t.narrator_id = teacher"""


def related(t):
    return edge_relations(edges(t.links), t.narrators.withColumn("tabaqa", F.col("narrator_id") % 12))


@query("kin_relation", f"SELECT relation, count(*) AS n FROM ({RELATIONS}) GROUP BY 1")
def _(t):
    return related(t).groupBy("relation").agg(F.count("*").alias("n"))


@query("edge_relations", RELATIONS)
def _(t):
    return related(t)


@query("tree_depth", "WITH RECURSIVE w AS (SELECT node_id, 0 AS depth FROM toc WHERE parent_id < 0 UNION ALL SELECT c.node_id, depth + 1 FROM toc c JOIN w ON c.parent_id = w.node_id) SELECT node_id, depth FROM w")
def _(t):
    return tree_depth(t.toc)


@query("breadcrumbs", "SELECT a.node_id, concat_ws(' > ', c.title, b.title, a.title) AS path FROM toc a LEFT JOIN toc b ON b.node_id = a.parent_id LEFT JOIN toc c ON c.node_id = b.parent_id")
def _(t):
    return breadcrumbs(t.toc)


@query("toc_children", "SELECT a.node_id, a.title, EXISTS (SELECT 1 FROM toc c WHERE c.parent_id = a.node_id) AS has_children, a.parent_id FROM toc a WHERE a.parent_id >= 0")
def _(t):
    parents = t.toc.select(F.col("parent_id").alias("p")).distinct()
    children = t.toc.where("parent_id >= 0")
    return children.join(parents, children.node_id == parents.p, "left").select("node_id", "title", F.col("p").isNotNull().alias("has_children"), "parent_id")


@query("subtree", "WITH RECURSIVE w AS (SELECT node_id FROM toc WHERE node_id < 5 AND node_id % 2 = 0 UNION ALL SELECT c.node_id FROM toc c JOIN w ON c.parent_id = w.node_id) SELECT node_id FROM w")
def _(t):
    roots = t.toc.where("node_id < 5 and node_id % 2 = 0").select(F.col("node_id").alias("ancestor_id"))
    return ancestors(t.toc).join(roots, "ancestor_id", "left_semi").select("node_id")


@query("who_narrated_from", f"WITH e AS ({EDGES}) SELECT student, weight FROM e WHERE teacher = 7 ORDER BY weight DESC, student LIMIT 20")
def _(t):
    return edges(t.links).where("teacher = 7").orderBy(F.desc("weight"), "student").limit(20).select("student", "weight")


@query("joint_count", f"WITH p AS ({PAIRS}) SELECT student, teacher, count(DISTINCT chain_id) AS chains FROM p GROUP BY 1, 2")
def _(t):
    return consecutive_pairs(t.links).groupBy("student", "teacher").agg(F.countDistinct("chain_id").alias("chains"))


@query("top_teachers", f"WITH e AS ({EDGES}) SELECT teacher, count(DISTINCT student) AS students, sum(weight)::BIGINT AS weight FROM e GROUP BY 1 ORDER BY students DESC, weight DESC, teacher LIMIT 20")
def _(t):
    return edges(t.links).groupBy("teacher").agg(F.countDistinct("student").alias("students"), F.sum("weight").alias("weight")).orderBy(F.desc("students"), F.desc("weight"), "teacher").limit(20)


@query("pair_passages", f"WITH p AS ({PAIRS}) SELECT DISTINCT c.passage_id FROM p JOIN chains c USING (chain_id) WHERE student = 3 AND teacher = 5")
def _(t):
    return consecutive_pairs(t.links).where("student = 3 and teacher = 5").join(t.chains, "chain_id").select("passage_id").distinct()


#: Passages of a (student, teacher) from which it is hot.
HOT_PAIR = 10_000


def mutabaat(links: DataFrame, chains: DataFrame, passages: DataFrame, n: int = 10, hot: int = HOT_PAIR) -> DataFrame:
    """For each passage of ``passages`` the others that share the most (student, teacher) rows with it:
    passage_id, other_id, shared, rank.

    Pairs with at most ``hot`` passages are joined.  What a passage has of the hot pairs is its
    signature: others that share nothing else with it are worth the same where their signatures are
    the same, so of each signature only the n + 1 smallest ids can be among the best n, and the best
    of all signatures are found once for each signature that is asked for.  So no hot pair is ever
    listed with its passages, and the result is exact: a passage of equal signature and smaller id
    shares as much at least, and is ahead."""
    rows = consecutive_pairs(links).join(chains.select("chain_id", "passage_id"), "chain_id")
    each = written(rows.groupBy("passage_id", "student", "teacher").agg(F.count("*").alias("m")), "pairs")
    pair = ["student", "teacher"]
    often = each.groupBy(*pair).agg(F.count("*").alias("c")).where(F.col("c") > hot).select(*pair, F.lit(True).alias("hot"))
    each = written(each.join(often, pair, "left"), "flagged")
    asked = passages.select("passage_id").distinct()
    cold = each.where("hot is null").drop("hot")
    own = cold.join(asked, "passage_id", "left_semi").withColumnRenamed("m", "k")
    other = cold.withColumnRenamed("passage_id", "other_id")
    joined = own.join(other, pair).where("passage_id <> other_id").groupBy("passage_id", "other_id").agg(F.sum(F.col("k") * F.col("m")).alias("shared"))

    signed = each.where("hot").groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct(*pair, "m"))).alias("signature"))
    smallest = F.row_number().over(Window.partitionBy("signature").orderBy("passage_id"))
    first = signed.withColumn("place", smallest).where(F.col("place") <= n + 1)
    kinds = written(first.groupBy("signature").agg(F.collect_list("passage_id").alias("ids")).withColumn("kind", F.monotonically_increasing_id()), "signatures")
    signed = written(signed.join(kinds.select("signature", "kind"), "signature"), "signed")
    wanted = signed.join(asked, "passage_id", "left_semi")
    parts = kinds.select("kind", F.inline("signature"))
    asking = parts.join(wanted.select("kind").distinct(), "kind", "left_semi").withColumnsRenamed({"kind": "asking", "m": "k"})
    alike = asking.join(parts, pair).groupBy("asking", "kind").agg(F.sum(F.col("k") * F.col("m")).alias("shared"))
    best = Window.partitionBy("asking").orderBy(F.desc("shared"), "other_id")
    listed = alike.join(kinds.select("kind", F.explode("ids").alias("other_id")), "kind")
    listed = listed.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n + 1).select(F.col("asking").alias("kind"), "other_id", "shared")
    hot_only = wanted.select("passage_id", "kind").join(listed, "kind").where("passage_id <> other_id").select("passage_id", "other_id", "shared")

    # others that share a cold pair also get what they share of the hot ones
    signature = lambda name, of: signed.select(F.col("passage_id").alias(name), F.col("signature").alias(of))
    both = joined.join(signature("passage_id", "a"), "passage_id", "left").join(signature("other_id", "b"), "other_id", "left")
    same = lambda x: F.filter("b", lambda y: (y["student"] == x["student"]) & (y["teacher"] == x["teacher"]))
    more = F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x["m"] * F.coalesce(F.get(same(x), F.lit(0))["m"], F.lit(0)))
    exact = both.select("passage_id", "other_id", (F.col("shared") + F.coalesce(more, F.lit(0))).alias("shared"))
    shared = exact.unionByName(hot_only).groupBy("passage_id", "other_id").agg(F.max("shared").alias("shared"))
    rank = Window.partitionBy("passage_id").orderBy(F.desc("shared"), "other_id")
    return shared.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


@query("mutabaat", f"WITH p AS (SELECT c.passage_id, student, teacher FROM ({PAIRS}) JOIN chains c USING (chain_id)), s AS (SELECT a.passage_id, b.passage_id AS other_id, count(*) AS shared FROM p a JOIN p b ON a.student = b.student AND a.teacher = b.teacher AND a.passage_id <> b.passage_id WHERE a.passage_id % 20 = 0 GROUP BY 1, 2) SELECT passage_id, other_id, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY shared DESC, other_id)::INT AS rank FROM s) WHERE rank <= 10")
def _(t):
    return mutabaat(t.links, t.chains, t.passages.where("passage_id % 20 = 0"))
