"""Hard negatives by a packed R-tree over vectors of integers.

1. Sort-tile-recursive packing in two levels.  The cuts of the upper one are fitted on a bounded
   sample (FIT numbers), every row gets its tile by them, and a tile that is larger than planned,
   such as that of a vector that very many rows have, is dealt into parts by id.  A task packs its
   part the same way into leaves and levels of boxes above them.
2. A minimum bounding box gives each coordinate an interval, and so the inner product with any
   anchor one.  The boxes of the tiles are at most DIRECTORY numbers, whatever the input, and are
   broadcast: an anchor is sent only to parts whose interval it can use.
3. In a part a queue takes the box with the greatest upper end first, and leaves out boxes whose
   interval lies outside all score windows of the anchor, or strictly below its k-th best so far
   (at equal scores: all of whose ids come after).
4. Positives are sought in the anchor's own tile first, which bounds the search in the others; then
   the score windows of the positives bound that of the negatives.

Scores are exact: in doubles as long as these hold the sums, else in whole numbers of any size.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take
no part; a shorter vector has zeros at its end; components beyond a long, and scores beyond it in
the result, are its ends.  Of rows of one id the least by label and vector takes part.  An anchor
without positives, and a positive without negatives, has no row.  An empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warraq.llm.common import written

#: Numbers of the sample that the upper cuts are fitted on, and of the boxes that are broadcast, at most.
FIT, DIRECTORY = 1 << 22, 1 << 20
#: Rows of a part, about, rows of a leaf, boxes of a box, slabs of a coordinate.
PART, LEAF, FAN, SLABS = 1 << 16, 128, 16, 4
#: Anchors whose bounds are computed at once.
SLICE = 256
LONG = (1 << 63) - 1


def levels_of(tiles: int, dims: int) -> int:
    """Coordinates that are cut so that there are about so many tiles."""
    n = 0
    while SLABS**n < tiles and n < dims:
        n += 1
    return n


class Cuts:
    """Sort-tile-recursive cuts: the widest coordinates in turn, each slab of one cut by the next."""

    def __init__(self, sample: np.ndarray, tiles: int):
        dims = sample.shape[1]
        spread = sample.astype(np.float64).std(axis=0) if len(sample) else np.zeros(dims)
        self.coords = np.argsort(-spread, kind="stable")[: levels_of(tiles, dims)]
        self.cuts, of = [], np.zeros(len(sample), dtype=np.int64)
        for level, c in enumerate(self.coords):
            own = np.full((SLABS**level, SLABS - 1), LONG, dtype=np.int64)
            by = np.lexsort((sample[:, c], of))
            starts = np.searchsorted(of[by], np.arange(SLABS**level + 1))
            for t, (a, b) in enumerate(zip(starts, starts[1:])):
                if b > a:
                    own[t] = sample[by[[a + (b - a) * k // SLABS for k in range(1, SLABS)]], c]
            self.cuts.append(own)
            of = of * SLABS + (sample[:, c, None] > own[of]).sum(axis=1)
        self.tiles = SLABS ** len(self.coords)

    def tile(self, rows: np.ndarray) -> np.ndarray:
        of = np.zeros(len(rows), dtype=np.int64)
        for c, own in zip(self.coords, self.cuts):
            of = of * SLABS + (rows[:, c, None] > own[of]).sum(axis=1)
        return of


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` integers, with zeros for what is missing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, cuts = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    cuts = cuts - cuts[0] if len(cuts) else cuts
    lengths = np.diff(cuts)
    if (lengths == dims).all():
        return values.reshape(len(column), dims)
    out = np.zeros((len(column), dims), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(values)) - np.repeat(cuts[:-1], lengths)] = values
    return out


def exact(a: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles where these hold all sums of their products, else as whole numbers."""
    most = [max((abs(int(x.max())), abs(int(x.min())))) if x.size else 0 for x in (a, *others)]
    kind = np.float64 if most[0] * max(most[1:], default=1) * max(a.shape[-1], 1) < 1 << 53 and max(most) < 1 << 53 else object
    return [x.astype(kind) for x in (a, *others)]


def intervals(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with what a box may hold."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


class Tree:
    """A packed R-tree over integer vectors: leaves of so many rows, and levels of boxes above them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        cuts = Cuts(rows, -(-len(rows) // leaf))
        by = np.lexsort((ids, cuts.tile(rows)))
        self.ids, self.labels, self.rows = ids[by], labels[by], rows[by]
        starts = np.arange(0, len(ids), leaf)
        lo, hi, first = np.minimum.reduceat(self.rows, starts), np.maximum.reduceat(self.rows, starts), np.minimum.reduceat(self.ids, starts)
        self.levels = [(lo, hi, first)]
        while len(lo) > 1:
            starts = np.arange(0, len(lo), FAN)
            lo, hi, first = np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts), np.minimum.reduceat(first, starts)
            self.levels.append((lo, hi, first))

    def searched(self, queries: np.ndarray, ids, labels, windows, same: bool, k: int):
        """For each query its best rows in each of its windows, as (query, window, score, id).

        A window is (low, high, score, id): scores from low to high, and better than the k-th (score,
        id) that is known; each may be None.  ``same``: rows of the query's label, else of others."""
        q, rows, *boxes = exact(queries, self.rows, *(b for lo, hi, _ in self.levels for b in (lo, hi)))
        bounds = [intervals(q, lo, hi) for lo, hi in zip(boxes[::2], boxes[1::2])]
        for i in range(len(q)):
            best = [[] for _ in windows[i]]  # (-score, id), in order
            known = [(-w[2], w[3]) if w[2] is not None else None for w in windows[i]]

            def wanted(least, most, first):
                """Windows that something between these scores, of ids from ``first`` on, can get into."""
                for j, (low, high, *_) in enumerate(windows[i]):
                    if (low is None or most >= low) and (high is None or least <= high):
                        kth = best[j][-1] if len(best[j]) == k else known[j]
                        if kth is None or (-most, first) <= kth:
                            return True
                return False

            top = len(self.levels) - 1
            queue = [(-bounds[top][1][i, n], top, n) for n in range(len(self.levels[top][2]))]
            heapq.heapify(queue)
            while queue:
                most, level, node = heapq.heappop(queue)
                if not wanted(bounds[level][0][i, node], -most, self.levels[level][2][node]):
                    continue
                if level:
                    least, greatest, first = bounds[level - 1][0][i], bounds[level - 1][1][i], self.levels[level - 1][2]
                    for n in range(node * FAN, min((node + 1) * FAN, len(first))):
                        if wanted(least[n], greatest[n], first[n]):
                            heapq.heappush(queue, (-greatest[n], level - 1, n))
                    continue
                a, b = node * self.leaf, (node + 1) * self.leaf
                scores, own = rows[a:b] @ q[i], self.ids[a:b]
                fits = ((self.labels[a:b] == labels[i]) == same) & (own != ids[i])
                for j, (low, high, *_) in enumerate(windows[i]):
                    ok = fits if low is None else fits & (scores >= low)
                    ok = ok if high is None else ok & (scores <= high)
                    kth = best[j][-1] if len(best[j]) == k else known[j]
                    if kth is not None:
                        ok = ok & (scores >= -kth[0])
                    at = np.flatnonzero(ok)
                    if len(at):
                        at = at[np.lexsort((own[at], -scores[at]))][:k]
                        best[j] = sorted(best[j] + [(-int(scores[x]), int(own[x])) for x in at])[:k]
            for j, found in enumerate(best):
                for minus, vec_id in found:
                    yield i, j, -minus, vec_id


def windows_of(targets: list[dict] | None, same: bool, low: int, high: int) -> list[tuple]:
    """Windows from what an anchor has: the k-th positive so far, or its positives, low to high percent of whose scores count."""
    targets = targets or []
    if same:
        return [(None, None, targets[0]["score"], targets[0]["vec_id"]) if targets else (None, None, None, None)]
    return [(-(-low * t["score"] // 100), high * t["score"] // 100, None, None) for t in targets]


FOUND = "anchor_id long, target long, target_score long, vec_id long, score long"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _found(dims, same, k, low, high, leaf):
    """A part's rows, then the anchors that were sent to it: each anchor's best."""

    def run(batches):
        held, tree = [], None
        for batch in batches:
            sides = batch.column("side").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(sides, 1))
            if cut:
                own = batch.slice(0, cut)
                held.append((own.column("vec_id").to_numpy(), own.column("label").to_numpy(), matrix(own.column("v"), dims)))
            for at in range(cut, batch.num_rows, SLICE):
                asked = batch.slice(at, min(SLICE, batch.num_rows - at))
                if tree is None and held:
                    tree = Tree(*(np.concatenate(x) for x in zip(*held)), leaf)
                    held = []
                if tree is None:
                    continue
                ids, targets = asked.column("vec_id").to_pylist(), asked.column("targets").to_pylist()
                windows = [windows_of(t, same, low, high) for t in targets]
                rows = []
                for i, j, score, vec_id in tree.searched(matrix(asked.column("v"), dims), ids, asked.column("label").to_pylist(), windows, same, k):
                    of = (None, None) if same else (targets[i][j]["vec_id"], targets[i][j]["score"])
                    rows.append((ids[i], *of, vec_id, min(max(score, -LONG - 1), LONG)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=FOUND_NAMES)

    return run


def _routed(directory, dims, where, low, high):
    """Anchors (vec_id, label, v, tile, targets), each for every part that may hold what it wants."""
    lo, hi, start, many, used = directory

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("tile").to_numpy()[:, None] == used[None, :]
            if where == "own":
                sent = own
            else:
                q, a, b = exact(matrix(batch.column("v"), dims), lo, hi)
                least, most = intervals(q, a, b)
                sent = np.zeros(own.shape, dtype=bool)
                for i, targets in enumerate(batch.column("targets").to_pylist()):
                    for lowest, highest, score, _ in windows_of(targets, where == "others", low, high):
                        floor = score if lowest is None else lowest
                        ok = np.ones(len(used), dtype=bool) if floor is None else most[i] >= floor
                        sent[i] |= (ok if highest is None else ok & (least[i] <= highest)).astype(bool)
                if where == "others":
                    sent &= ~own
            row, tile = np.nonzero(sent)
            times = many[tile]
            row, first = np.repeat(row, times), np.repeat(start[tile], times)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            for at in range(0, len(row), 4096):
                taken = batch.take(pa.array(row[at : at + 4096]))
                part = pa.array((first + offset)[at : at + 4096].astype(np.int32))
                columns = [part, pa.array(np.ones(len(part), dtype=np.int32)), *(taken.column(c) for c in ("vec_id", "label", "v", "targets"))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "side", "vec_id", "label", "v", "targets"])

    return run


def _boxes(dims):
    """Rows (tile, n, lo, hi), from rows with vectors or from such rows, one a tile."""

    def run(batches):
        boxes = {}
        for batch in batches:
            tiles = batch.column("tile").to_pylist()
            if "v" in batch.schema.names:
                rows = matrix(batch.column("v"), dims)
                n, lo, hi = np.ones(len(rows), dtype=np.int64), rows, rows
            else:
                n, lo, hi = batch.column("n").to_numpy(), matrix(batch.column("lo"), dims), matrix(batch.column("hi"), dims)
            for t in np.unique(tiles) if len(tiles) else []:
                at = np.array(tiles) == t
                have = boxes.get(t)
                new = (int(n[at].sum()), lo[at].min(axis=0), hi[at].max(axis=0))
                boxes[t] = new if have is None else (have[0] + new[0], np.minimum(have[1], new[1]), np.maximum(have[2], new[2]))
        if boxes:
            columns = [pa.array(list(boxes), pa.int64()), *(pa.array([b[i].tolist() if i else b[i] for b in boxes.values()], t) for i, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))))]
            yield pa.RecordBatch.from_arrays(columns, names=["tile", "n", "lo", "hi"])

    return run


def one_of_each_id(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, label, v) with the least row of each id."""
    again = written(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "again")
    if again.isEmpty():
        return rows
    least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")
    return rows.join(again, "vec_id", "left_anti").unionByName(least)


def packed(rows: DataFrame) -> tuple[DataFrame, tuple, int]:
    """Rows with tile and part, written; the directory of the tiles; and the number of coordinates."""
    spark = rows.sparkSession
    rows = written(rows, "vectors")
    total, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims = max(dims, 1)
    most = max(1, DIRECTORY // (2 * dims))
    tiles = max(1, min(most // SLABS, max(-(-total // PART), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    step = max(1, -(-total * dims // FIT))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).select("v").toArrow()  # FIT numbers, about
    cuts = Cuts(matrix(sample.column("v"), dims) if sample.num_rows else np.zeros((0, dims), np.int64), tiles)

    def tiled(batches):
        for batch in batches:
            tile = cuts.tile(matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), pa.array(tile)], names=["vec_id", "label", "v", "tile"])

    placed = written(rows.mapInArrow(tiled, "vec_id long, label long, v array<long>, tile long"), "tiled")
    ddl = "tile long, n long, lo array<long>, hi array<long>"
    boxes = placed.select("tile", "v").mapInArrow(_boxes(dims), ddl).repartition("tile").mapInArrow(_boxes(dims), ddl)
    boxes = boxes.orderBy("tile").toArrow()  # DIRECTORY numbers at most
    if not boxes.num_rows:
        return placed.withColumn("part", F.lit(0)), None, dims
    n, used = (boxes.column(c).to_numpy() for c in ("n", "tile"))
    many = -(-n // max(LEAF, 2 * total // cuts.tiles))
    start = np.cumsum(many) - many
    sizes = spark.createDataFrame(list(zip(used.tolist(), start.tolist(), many.tolist())), "tile long, start long, many long")
    part = (F.col("start") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).cast("int")
    parts = placed.join(F.broadcast(sizes), "tile").select("vec_id", "label", "v", "tile", part.alias("part"))
    return written(parts, "parts"), (matrix(boxes.column("lo"), dims), matrix(boxes.column("hi"), dims), start, many, used), dims


TARGETS = "array<struct<vec_id: long, score: long>>"


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each row (vec_id, label, v) that ``anchor`` holds for, and each of its best ``positives`` of the
    same label, the best ``negatives`` of other labels that score from ``low`` to ``high`` percent of it:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    parts, directory, dims = packed(one_of_each_id(rows))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if directory is None:
        return rows.sparkSession.createDataFrame([], ", ".join(f"{c} {'int' if c == 'rank' else 'long'}" for c in names))
    anchors = parts.where(anchor).select("vec_id", "label", "v", "tile", F.lit(None).cast(TARGETS).alias("targets"))
    schema = f"part int, side int, vec_id long, label long, v array<long>, targets {TARGETS}"
    corpus = parts.select("part", F.lit(0).alias("side"), "vec_id", "label", "v", F.lit(None).cast(TARGETS).alias("targets"))
    n_parts = int(directory[3].sum())
    best = lambda by, id_: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), id_))

    def search(asked, where, k):
        same = where != "windows"
        sent = asked.mapInArrow(_routed(directory, dims, where, low, high), schema)
        dealt = corpus.unionByName(sent).repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "side", "vec_id")
        return written(dealt.mapInArrow(_found(dims, same, k, low, high, LEAF), FOUND), where)

    kept = lambda found: found.withColumn("rank", best(["anchor_id"], "vec_id")).where(F.col("rank") <= positives)
    target = F.struct("vec_id", "score")
    listed = lambda df, of: df.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(of).alias("targets"))
    near = search(anchors, "own", positives)
    kth = listed(kept(near).where(F.col("rank") == positives), target)
    bare = anchors.drop("targets")
    far = search(bare.join(kth, "vec_id", "left").select(anchors.columns), "others", positives)
    chosen = listed(written(kept(near.unionByName(far)), "positives"), target)
    found = search(bare.join(chosen, "vec_id").select(anchors.columns), "windows", negatives)
    ranked = found.withColumn("rank", best(["anchor_id", "target"], "vec_id")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", F.col("target").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("target_score").alias("positive_score"), F.col("score").alias("negative_score"))


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """Rows (vec_id, label, v) of ``table`` (vec_id, label, embedding) that take part: components times
    ``scale``, rounded down."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~odd)
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5"""
}
