"""The trie of all prefixes of conversations, by Z-fast tries over batches of them.

1. Turns get their places by a scan in ranges; conversations are rebuilt (opening turns of another,
   then their own) and become rows of at most SEGMENT turns: a digest and the bytes of each turn.
   A prefix is known by the sums of its turns' hashes, which depend on the depth (128 bits).
2. A task inserts its conversations, a batch at a time, into Z-fast tries: compacted nodes are held
   in a table under the prefix at their handle, the two-fattest depth of their edge; a fat binary
   search over depths finds the exit node of a conversation in about log(length) lookups, where its
   rest becomes a leaf or splits an edge.  Then edges are expanded to a node for each depth.
3. Nodes of all batches meet by their prefix.  A prefix that all conversations share is a row of
   each batch there, so no prefix is hot; ids of conversations that end at a node travel packed, by
   ranges of ids, and are hashed as one ascending stream.
4. Sums over subtrees: nodes with the same smallest member are a path; paths hang on others.  Totals
   of paths come by pointer doubling, and what remains is a running sum along each path, from its
   end, again by a scan in ranges.

Defined results: a null role or text is empty; rows without conversation take no part; turns of
equal number come in the order of their digests; turns that repeat stay, as turns of their own; an
empty table gives an empty result; further columns are not looked at.  Only the digest of 128 bits
tells turns apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm.common import joined_by_size, written
from warraq.llm.hashing import mixed
from warraq.operators.ordering import numbered

#: Turns of a row, turns of a batch, bits of an id that are not of its range.
SEGMENT, BATCH, RANGE_BITS = 1024, 200_000, 16
#: Opening turns that a conversation takes at most from the other, and how many ids share one.
MOST_OPENING, FAMILY = 8, 5
#: Rows of a key from which it is sent to all (at most 1000 keys).
LARGE = 100
KEY = ["depth", "h1", "h2"]


def two_fattest(a: int, b: int) -> int:
    """The number of (a, b] with the most trailing zero bits."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class Word:
    """A conversation's part as hashes of its prefixes (index 0: what is before it) and bytes of its turns."""

    __slots__ = ("h1", "h2", "sizes", "n")

    def __init__(self, digests: np.ndarray, sizes: np.ndarray, base: int = 0, b1: int = 0, b2: int = 0):
        h = hashed(digests, base)
        self.h1 = np.cumsum(np.concatenate([[np.uint64(b1 & (1 << 64) - 1)], h[:, 0]]), dtype=np.uint64)
        self.h2 = np.cumsum(np.concatenate([[np.uint64(b2 & (1 << 64) - 1)], h[:, 1]]), dtype=np.uint64)
        self.sizes, self.n = sizes, len(sizes)

    def at(self, depth: int) -> tuple[int, int, int]:
        return depth, int(self.h1[depth]), int(self.h2[depth])

    def common(self, other: Word, most: int, least: int = 0) -> int:
        """Turns that both begin with, ``most`` at most and known to be ``least`` at least."""
        unlike = np.flatnonzero((self.h1[least + 1 : most + 1] != other.h1[least + 1 : most + 1]) | (self.h2[least + 1 : most + 1] != other.h2[least + 1 : most + 1]))
        return least + int(unlike[0]) if len(unlike) else most


def hashed(digests: np.ndarray, base: int) -> np.ndarray:
    """Two hashes of each turn (two 64-bit halves of its digest) at its depth, ``base`` turns being before the first."""
    depth = np.arange(base + 1, base + len(digests) + 1, dtype=np.uint64)
    return np.stack([mixed(digests[:, 0] ^ mixed(depth)), mixed(digests[:, 1] + mixed(~depth))], axis=1) if len(digests) else np.zeros((0, 2), np.uint64)


class ZFastTrie:
    """Compacted nodes: an edge from the parent's extent (``top``) to the node's own (``end``), as depths
    of a word that goes through it.  ``table`` holds them by the prefix at their handle, ``kids`` by
    the first prefix of their edge."""

    def __init__(self, root: Word):
        self.top, self.end, self.word, self.parent = [-1], [0], [root], [-1]
        self.passing, self.least, self.closed = [0], [None], [[]]
        self.table: dict[tuple, int] = {}
        self.kids: dict[tuple, int] = {}

    def handle(self, node: int) -> tuple:
        return self.word[node].at(two_fattest(self.top[node], self.end[node]))

    def exit_node(self, x: Word) -> int:
        """The deepest node whose handle is on the path of ``x``: a binary search over depths that tries
        the two-fattest one of those that are left."""
        node, a, b = 0, 0, x.n
        while a < b:
            f = two_fattest(a, b)
            hit = self.table.get(x.at(f))
            if hit is None:
                b = f - 1
            else:
                node, a = hit, self.end[hit]
        return node

    def added(self, top: int, end: int, word: Word, parent: int) -> int:
        node = len(self.top)
        self.top.append(top)
        self.end.append(end)
        self.word.append(word)
        self.parent.append(parent)
        self.passing.append(0)
        self.least.append(None)
        self.closed.append([])
        self.kids[word.at(top + 1)] = node
        self.table[self.handle(node)] = node
        return node

    def split(self, node: int, depth: int) -> int:
        """A node of its own for the part of an edge down to ``depth``."""
        del self.table[self.handle(node)]
        middle = self.added(self.top[node], depth, self.word[node], self.parent[node])
        self.top[node], self.parent[node] = depth, middle
        self.kids[self.word[node].at(depth + 1)] = node
        self.table[self.handle(node)] = node
        return middle

    def insert(self, x: Word, conv_id: int, closes: bool) -> None:
        node = self.exit_node(x)
        shared = x.common(self.word[node], min(x.n, self.end[node]))
        while shared == self.end[node] < x.n:  # the edge is on the path: below it, if anything is there
            child = self.kids.get(x.at(shared + 1))
            if child is None:
                node = self.added(shared, x.n, x, node)
                shared = x.n
                break
            node, shared = child, x.common(self.word[child], min(x.n, self.end[child]), shared + 1)
        if shared < self.end[node]:
            node = self.split(node, shared)
            if shared < x.n:
                node = self.added(shared, x.n, x, node)
        self.passing[node] += 1
        self.least[node] = conv_id if self.least[node] is None else min(conv_id, self.least[node])
        if closes:
            self.closed[node].append(conv_id)

    def counted(self) -> None:
        """Members and the smallest of them for each node, from those that end there."""
        for node in sorted(range(1, len(self.top)), key=lambda i: -self.end[i]):
            up = self.parent[node]
            self.passing[up] += self.passing[node]
            self.least[up] = self.least[node] if self.least[up] is None else min(self.least[up], self.least[node])


NODES = pa.schema([("depth", pa.int64()), *((c, pa.int64()) for c in ("h1", "h2", "p1", "p2")), ("bytes", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("range", pa.int64()), ("ids", pa.binary())])
NODES_DDL = "depth long, h1 long, h2 long, p1 long, p2 long, bytes long, n long, conv_id long, range long, ids binary"


def expanded(trie: ZFastTrie, base: int, range_bits: int = RANGE_BITS):
    """A row for each depth of each edge, and rows with the ids that end at a node, by ranges of ids."""
    trie.counted()
    parts, n, least, kept = [], [], [], []
    for node in range(len(trie.top)):
        a, b, w = trie.top[node] + 1, trie.end[node] + 1, trie.word[node]
        if node == 0 and base:  # what is before the segment is a node of the segment before
            continue
        before = slice(max(a - 1, 0), b - 1)
        h1, h2 = w.h1[a:b], w.h2[a:b]
        root = node == 0
        p1, p2 = (h1, h2) if root else (w.h1[before], w.h2[before])
        sizes = np.zeros(1, np.int64) if root else w.sizes[before]
        parts.append((np.arange(base + a, base + b), h1, h2, p1, p2, sizes))
        n.append(np.full(b - a, trie.passing[node]))
        least.append(np.full(b - a, trie.least[node] if trie.least[node] is not None else -1))
        if trie.closed[node]:
            ids = np.sort(np.array(trie.closed[node], dtype=np.int64))
            ranges = ids >> range_bits
            cuts = np.flatnonzero(np.diff(ranges)) + 1
            for own in np.split(ids, cuts):
                kept.append((base + trie.end[node], int(h1[-1].view(np.int64)), int(h2[-1].view(np.int64)), int(own[0] >> range_bits), own.tobytes()))
    if parts:
        columns = [np.concatenate(c).astype(np.uint64).view(np.int64) for c in zip(*parts)]
        columns += [np.concatenate(n), np.concatenate(least)]
        none = pa.nulls(len(columns[0]))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), none.cast(pa.int64()), none.cast(pa.binary())], schema=NODES)
    if kept:
        depth, h1, h2, of, ids = zip(*kept)
        null = pa.nulls(len(kept)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (depth, h1, h2)), null, null, null, null, null, pa.array(of, pa.int64()), pa.array(ids, pa.binary())], schema=NODES)


def _words(batch: pa.RecordBatch):
    """(conv_id, base, whether it is the conversation's end, word) of rows of segments."""
    ids, base, b1, b2, closes = (batch.column(c).to_pylist() for c in ("conv_id", "base", "b1", "b2", "closes"))
    turns = batch.column("turns")
    cuts = turns.offsets.to_numpy()
    digest = pa.concat_arrays([turns.values.field("digest")]).slice(0)
    every = np.frombuffer(b"".join(digest.to_pylist()), dtype="<u8").reshape(-1, 2) if len(digest) else np.zeros((0, 2), np.uint64)
    sizes = turns.values.field("bytes").to_numpy(zero_copy_only=False)
    for i, conv_id in enumerate(ids):
        at = slice(cuts[i], cuts[i + 1])
        yield conv_id, base[i], closes[i], Word(every[at], sizes[at], base[i], b1[i], b2[i])


def _tries(most: int, range_bits: int):
    """Expanded nodes of the tries of each batch, of about ``most`` turns, of a task's segments."""

    def run(batches):
        tries, held = {}, 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for conv_id, base, closes, word in _words(batch):
                    key = (base, int(word.h1[0]), int(word.h2[0]))
                    if key not in tries:
                        tries[key] = ZFastTrie(word)
                    tries[key].insert(word, conv_id, closes)
                    held += word.n + 1
                    if held >= most:
                        for (b, *_), trie in tries.items():
                            yield from expanded(trie, b, range_bits)
                        tries, held = {}, 0
            for (b, *_), trie in tries.items():
                yield from expanded(trie, b, range_bits)

    return run


def _merged(batches):
    """Rows sorted by node, one node's statistics before its ids in ascending ranges, as one row a node."""
    names = [*KEY, "p1", "p2", "bytes", "n", "conv_id", "ends_sha256"]
    types = [pa.int64()] * 8 + [pa.string()]
    key = stats = digest = None
    waiting, of, out = [], None, []

    def flushed():
        nonlocal digest, waiting
        if waiting:
            ids = np.sort(np.concatenate(waiting)).tolist()
            digest.update((("," if digest_begun[0] else "") + ",".join(map(str, ids))).encode())
            digest_begun[0] = True
            waiting = []

    digest_begun = [False]

    def closed():
        flushed()
        out.append((*key, *stats, digest.hexdigest()))

    def sent():
        nonlocal out
        rows, out = out, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for d, h1, h2, p1, p2, size, n, least, range_, ids in zip(*(batch.column(c).to_pylist() for c in NODES.names)):
            if (d, h1, h2) != key:
                if key is not None:
                    closed()
                key, stats, digest, of = (d, h1, h2), [p1, p2, size, 0, least], hashlib.sha256(), None
                digest_begun[0] = False
            if range_ is None:
                stats[3] += n
                stats[4] = min(stats[4], least)
            else:
                if range_ != of:
                    flushed()
                    of = range_
                waiting.append(np.frombuffer(ids, np.int64))
        if len(out) >= 10_000:
            yield sent()
    if key is not None:
        closed()
    if out:
        yield sent()


def opening(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first of its family."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_OPENING + 1))


def _lanes(batches):
    """Sums of the hashes of each segment, as unsigned halves, which can be added up without overflow."""
    with np.errstate(over="ignore"):
        for batch in batches:
            rows = [(i, s, *(int(h) >> k & 0xFFFFFFFF for h in (w.h1[-1], w.h2[-1]) for k in (0, 32))) for (i, _, _, w), s in zip(_words(batch), batch.column("seg").to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["conv_id", "seg", "l0", "l1", "l2", "l3"])


def segments(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, base, b1, b2, closes, turns) of the rebuilt conversations: turns (place, digest,
    bytes) in order, the number of turns before them and the hash of these, and whether they are the last."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    turns = numbered(rows.where("conv_id is not null"), ["conv_id"], [F.col("turn").asc_nulls_first(), "digest"]).drop("turn")
    turns = written(turns, "turns")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("size")).select("conv_id", "size", first.alias("source"), opening(F.col("conv_id")).alias("h"))
    convs = written(convs, "conversations")
    early = turns.where(F.col("pos") <= MOST_OPENING).withColumnRenamed("conv_id", "source")
    taken = convs.join(early, "source").where(F.col("pos") <= F.col("h")).select("conv_id", "pos", "digest", "bytes")
    own = turns.where(F.col("pos") > opening(F.col("conv_id"))).select("conv_id", "pos", "digest", "bytes")
    seg = F.floor((F.col("pos") - 1) / SEGMENT)
    made = taken.unionByName(own).groupBy("conv_id", seg.alias("seg")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("turns"))
    made = written(made, "segments")
    zero = F.lit(0).cast("long")
    # without turns: nothing of its own is left, and the other has none
    sizes = convs.select(F.col("conv_id").alias("source"), F.lit(True).alias("there"))
    bare = convs.where(F.col("size") <= F.col("h")).join(sizes, "source", "left").where("there is null or h = 0")
    empty = F.lit([]).cast(made.schema["turns"].dataType)
    bare = bare.select("conv_id", zero.alias("base"), zero.alias("b1"), zero.alias("b2"), F.lit(True).alias("closes"), empty.alias("turns"))
    far = made.where("seg > 0").select("conv_id").distinct()
    if far.isEmpty():
        return made.select("conv_id", zero.alias("base"), zero.alias("b1"), zero.alias("b2"), F.lit(True).alias("closes"), "turns").unionByName(bare)
    # conversations of several segments: the turns before each, then the hashes of these
    placed = numbered(made.select("conv_id", "seg", F.size("turns").cast("long").alias("n")), ["conv_id"], ["seg"], ["n"])
    last = placed.groupBy("conv_id").agg(F.max("seg").alias("last"))
    placed = placed.join(last, "conv_id").select("conv_id", "seg", (F.col("n_so_far") - F.col("n")).alias("base"), (F.col("seg") == F.col("last")).alias("closes"))
    made = made.join(placed, ["conv_id", "seg"]).select("conv_id", "seg", "base", zero.alias("b1"), zero.alias("b2"), "closes", "turns")
    lanes = ["l0", "l1", "l2", "l3"]
    sums = made.mapInArrow(_lanes, "conv_id long, seg long, " + ", ".join(f"{c} long" for c in lanes))
    sums = numbered(sums, ["conv_id"], ["seg"], lanes).select("conv_id", "seg", *((F.col(f"{c}_so_far") - F.col(c)).alias(c) for c in lanes))

    def joined(low, high):
        """A wrapped 64-bit sum from sums of its halves."""
        low, high = F.col(low), F.col(high)
        top = F.pmod(high + F.shiftright(low, 32), F.lit(1 << 32))
        return F.shiftleft(top, 32).bitwiseOR(F.pmod(low, F.lit(1 << 32)))

    sums = sums.select("conv_id", "seg", joined("l0", "l1").alias("b1"), joined("l2", "l3").alias("b2"))
    made = made.drop("b1", "b2").join(sums, ["conv_id", "seg"]).select("conv_id", "base", "b1", "b2", "closes", "turns")
    return made.unionByName(bare)


def path_totals(paths: DataFrame, values: list[str], total: int, rounds: int = 64) -> DataFrame:
    """``paths`` (path, up, values) with the values summed over each path and all that hang below it.

    Pointer doubling: before round k a path has the sum of those less than 2 ** k below it, and
    points 2 ** k up; then it adds what points at it."""
    state = written(paths, "paths")
    for _ in range(rounds):
        given = state.where("up is not null").groupBy("up").agg(*(F.sum(v).alias(f"_{v}") for v in values), F.count("*").alias("_size"))
        given = written(given, "given")
        if given.isEmpty():
            return state
        ahead = given.join(state.select(F.col("path").alias("up"), F.col("up").alias("_up")), "up").select("up", "_up", "_size")
        moved = joined_by_size(state, ahead, ["up"], "_size", total, LARGE).drop("_size")
        more = given.drop("_size").withColumnRenamed("up", "path")
        sums = [(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]
        state = written(moved.join(more, "path", "left").select("path", F.col("_up").alias("up"), *sums), "paths")
    raise RuntimeError("paths did not settle")


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """A row for each distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    dealt = segments(conversations).mapInArrow(_tries(BATCH, RANGE_BITS), NODES_DDL)
    sorted_ = dealt.repartition(*KEY).sortWithinPartitions(*KEY, F.col("range").asc_nulls_first())
    nodes = sorted_.mapInArrow(_merged, "depth long, h1 long, h2 long, p1 long, p2 long, bytes long, n long, conv_id long, ends_sha256 string")
    nodes = written(nodes, "nodes")
    total = nodes.count()
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")]
    children = nodes.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").fillna(0, ["n_children"])
    childless = (F.col("n_children") == 0).cast("long")
    nodes = written(nodes.withColumns({"leaves": childless, "saved": (F.col("n") - 1) * F.col("bytes")}), "nodes")
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("up"), "n_children")
    rows = nodes.withColumnRenamed("n_children", "own_children")
    nodes = written(joined_by_size(rows, parents, ["depth", "p1", "p2"], "n_children", total, LARGE).drop("n_children"), "nodes")

    # a path begins where the smallest member is another than the parent's
    heads = nodes.where("depth = 0 or up <> conv_id").select(F.col("conv_id").alias("path"), "up", *above)
    values = ["leaves", "saved"]
    own = nodes.groupBy(F.col("conv_id").alias("path")).agg(*(F.sum(v).alias(v) for v in values))
    totals = path_totals(heads.join(own, "path").select("path", "up", *values), values, total)
    hung = heads.where("up is not null").drop("up").join(totals.drop("up"), "path").groupBy(*KEY).agg(*(F.sum(v).alias(f"_{v}") for v in values))
    sums = {v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}
    nodes = nodes.join(hung, KEY, "left").withColumns(sums)
    along = numbered(nodes.select("conv_id", "depth", "up", "n", "own_children", *values, "ends_sha256"), ["conv_id"], [F.col("depth").desc()], values)
    return along.select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("own_children").alias("n_children"),
        F.col("leaves_so_far").alias("n_leaves"), F.col("saved_so_far").alias("saved_tokens"), "ends_sha256",
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {
    "op13_prefix_trie": """
WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(concat(length(coalesce(role, ''))::VARCHAR, ':', coalesce(role, ''), coalesce(text, '')))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, conv_id - conv_id % 5 AS source,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
      lambda a, s: list_reduce(list_prepend(xor(a, s), range(8)),
        lambda b, k: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384::BIGINT) ELSE b // 2 END))) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
  r AS (SELECT c.conv_id, pos, x FROM c JOIN t ON t.conv_id = c.source WHERE pos <= h
    UNION ALL SELECT c.conv_id, pos, x FROM c JOIN t ON t.conv_id = c.conv_id WHERE pos > h),
  w AS (SELECT c.conv_id, coalesce(list(x ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS p FROM c LEFT JOIN r USING (conv_id) GROUP BY 1),
  m AS (SELECT conv_id, p[1:d] AS p, d, d = len(p) AS ends FROM (SELECT conv_id, p, unnest(generate_series(0, len(p))) AS d FROM w)),
  n AS (SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
    (count(*) - 1) * coalesce(strlen(p[d].t), 0) AS saved FROM m GROUP BY p, d),
  k AS (SELECT a.p, a.depth, count(b.p) AS n_children FROM n a LEFT JOIN n b ON b.depth = a.depth + 1 AND b.p[1:a.depth] = a.p GROUP BY 1, 2),
  s AS (SELECT a.p, a.depth, sum(b.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves
    FROM n a JOIN n b ON b.depth >= a.depth AND b.p[1:a.depth] = a.p JOIN k ON k.p = b.p AND k.depth = b.depth GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN k ON k.p = n.p AND k.depth = n.depth JOIN s ON s.p = n.p AND s.depth = n.depth LEFT JOIN n u ON u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]"""
}
