"""Jaccard self-join on word shingles by prefix trees.

1. Equal sets are one class, with its smallest id as representative (pre-aggregated, so a group of
   copies is one row a task).  A count sketch of fixed size gives all shingles one global order,
   rare ones first; ties go by hash.
2. Two sets that reach the threshold share a shingle of their prefixes (the first
   n - ceil(0.75 n) + 1 in that order).  Prefixes are dealt by shingle; of sets that share one,
   those whose sizes and places allow the threshold are joined, a part sends a spanning forest of
   them and not the pairs, and its components are families: every link lies within a family.
   Parity bitmaps of the members, an eighth of a byte for each shingle, then show which pairs
   cannot be linked, and families fall apart into those whose texts are worth sending.
3. A family (in blocks, when large: each block meets each other one of compatible size) is stored
   as a prefix tree of its globally ordered sets.  One walk carries the partial overlaps with all
   sets at once, so sets below a node share them, and a subtree is left as soon as the overlap so
   far and the lengths that remain cannot reach the threshold.  Links give exact counts; a
   spanning forest of them goes on, whose components are the result.

Graphs are of classes (a class is numbered by the 64-bit sum of its set), so ids may repeat.

Defined results: a null text or one without words has an empty set and is linked with nothing;
fewer than five words are one shingle; equal texts are one class.  A document is a distinct (id,
set): rows that repeat both count once among the links and have the same result; rows of one id
with different sets are documents of their own, and count as each other's links where they are
near.  Rows without id have a null component and no links; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warraq.llm.common import FEW, components, documents, few, joined_by_size, joined_labels, marked, released, small_batches, text_of, thinned, without, written
from warraq.llm.shingles import shingle_sets

#: Links have NUMERATOR / DENOMINATOR of their union in common, at least.
NUMERATOR, DENOMINATOR = 75, 100
#: Bits of a shingle's place in the sketch, and places of a chunk of it.
SKETCH_BITS, CHUNK_BITS = 22, 16
#: Shingles of a block of a family; a document counts as SMALL at least, so that a block has at most BLOCK / SMALL.
BLOCK, SMALL = 500_000, 1_000
#: Bits of a set's parity bitmap, at most.
MOST_BITS = 1 << 16
#: Postings that a task gathers before it sends them on, and those of a part, about.
SEND, PART = 250_000, 1_000_000
#: Postings of one shingle whose pairs are looked at one by one.
LARGE = 4096


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def needed(a, b):
    """Least overlap of linked sets of a and b elements."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def signature_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: equal for equal sets, and else not but by accident."""
    with np.errstate(over="ignore"):
        return (int(s.sum().astype(np.int64)), int((s * (s >> np.uint64(7) | np.uint64(1))).sum().astype(np.int64))) if len(s) else (0, 0)


def _sized(batches):
    """For each text its set's size and signature, and at the end the task's share of the sketch."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["doc_id", "h", "n_shingles", "s1", "s2", "chunk", "counts"]
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    for batch in batches:
        n, s1, s2 = [], [], []
        for s in shingle_sets(batch.column(1).to_pylist()):
            n.append(len(s))
            a, b = signature_of(s)
            s1.append(a)
            s2.append(b)
            places = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            if len(s) < 1 << 16:
                sketch[places] += 1  # two of a set in one place count once: an order, not a result
            else:
                sketch += np.bincount(places, minlength=len(sketch))
        none = pa.nulls(len(n))
        own = [batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in (n, s1, s2))]
        yield pa.RecordBatch.from_arrays([*own, none.cast(pa.int32()), none.cast(pa.binary())], names=names)
    chunks = np.minimum(sketch, 0xFFFF).astype(np.uint16).reshape(-1, 1 << CHUNK_BITS)
    k = len(chunks)
    nulls = [pa.nulls(k).cast(t) for t in kinds[:5]]
    yield pa.RecordBatch.from_arrays([*nulls, pa.array(range(k), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())], names=names)


def _summed(batches):
    sums = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, dtype=np.uint16).astype(np.uint64)
    for chunk, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.minimum(s, 0xFFFFFFFF).astype(np.uint32).tobytes()])], names=["chunk", "counts"])


def ordered(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set in the global order: by place count, then by hash."""
    key = np.minimum(sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], (1 << 20) - 1).astype(np.uint64) << np.uint64(44)
    return s[np.argsort(key | (s >> np.uint64(20)), kind="stable")]


def _prefixes(batches, sketch, parts):
    """A task's prefixes, dealt by shingle: rows (part, ids, sizes, set and place of each posting, shingles)."""

    def sent():
        order, of, place = map(np.concatenate, (shingles, owner, places))
        part = (order % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        order, of, place, part = order[by], of[by], place[by], part[by]
        edges = np.searchsorted(part, np.arange(parts + 1))
        every_id, every_n = np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int32)
        rows = []
        for p in range(parts):
            a, b = edges[p], edges[p + 1]
            if b > a:
                own, local = np.unique(of[a:b], return_inverse=True)
                rows.append((p, every_id[own].tobytes(), every_n[own].tobytes(), local.astype(np.int32).tobytes(), place[a:b].tobytes(), order[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 5])], names=["part", "ids", "sizes", "of", "places", "shingles"])

    ids, sizes, owner, places, shingles, n, seen = [], [], [], [], [], 0, set()
    for batch in batches:
        for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist())):
            if len(s) and doc_id is not None:
                node = signature_of(s)[0]
                if node in seen:  # a task sends equal sets once
                    continue
                seen.add(node)
                first = ordered(s, sketch)[: prefix_length(len(s))]
                owner.append(np.full(len(first), len(ids), dtype=np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
                shingles.append(first)
                ids.append(node)
                sizes.append(len(s))
                n += len(first)
                if n >= SEND:
                    yield sent()
                    ids, sizes, owner, places, shingles, n, seen = [], [], [], [], [], 0, set()
    if n:
        yield sent()


def possible(n1, p1, n2, p2):
    """Whether sets of these sizes, with a common shingle at these places, can reach the threshold:
    before it they share no more than the lesser place, after it no more than the lesser rest."""
    n1, n2 = n1.astype(np.int64), n2.astype(np.int64)
    reach = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1, n2 - p2) - 1
    return (DENOMINATOR * np.minimum(n1, n2) >= NUMERATOR * np.maximum(n1, n2)) & (reach >= needed(n1, n2))


def group_pairs(start: np.ndarray, length: np.ndarray, n: np.ndarray, p: np.ndarray):
    """Arrays (i, j) of the possible pairs of each group of postings (equal shingle, in order of
    size); a group beyond LARGE is joined in a row, which keeps together all that could be pairs."""
    for k in np.unique(length[(length > 1) & (length <= 32)]).tolist():
        at, (x, y) = start[length == k], np.triu_indices(k, 1)
        step = max(1, 200_000 // len(x))
        for c in range(0, len(at), step):
            i, j = (at[c : c + step, None] + x).ravel(), (at[c : c + step, None] + y).ravel()
            ok = possible(n[i], p[i], n[j], p[j])
            yield i[ok], j[ok]
    for at, k in zip(start[length > 32].tolist(), length[length > 32].tolist()):
        if k > LARGE:
            i = np.arange(at, at + k - 1)
            near = DENOMINATOR * n[i].astype(np.int64) >= NUMERATOR * n[i + 1].astype(np.int64)
            yield i[near], i[near] + 1
            continue
        for r in range(0, k, 128):
            i, j = np.arange(at + r, min(at + r + 128, at + k))[:, None], np.arange(at + r, at + k)[None, :]
            x, y = np.nonzero((i < j) & possible(n[i], p[i], n[j], p[j]))
            yield at + r + x, at + r + y


def _stars(batches):
    """Edges from each set to the first of those that it may be linked with, directly or by others."""
    ids, sizes, owner, places, shingles, at = [], [], [], [], [], 0
    for batch in batches:
        for i, n, of, p, s in zip(*(batch.column(c).to_pylist() for c in range(1, 6))):
            ids.append(np.frombuffer(i, np.int64))
            sizes.append(np.frombuffer(n, np.int32))
            owner.append(np.frombuffer(of, np.int32) + np.int32(at))
            places.append(np.frombuffer(p, np.int32))
            shingles.append(np.frombuffer(s, np.uint64))
            at += len(ids[-1])
    if not ids:
        return
    ids, sizes, owner, places, shingles = map(np.concatenate, (ids, sizes, owner, places, shingles))
    by = np.argsort(shingles, kind="stable")
    again = np.zeros(len(by), dtype=bool)
    again[1:] = shingles[by[1:]] == shingles[by[:-1]]
    again[:-1] |= again[1:]
    by = by[again]  # shingles of one set alone join nothing
    by = by[np.lexsort((sizes[owner[by]], shingles[by]))]
    owner, places, shingles = owner[by], places[by], shingles[by]
    n, p = sizes[owner], places
    start = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]])) if len(by) else np.empty(0, np.int64)
    length = np.diff(np.append(start, len(by)))
    _, number = np.unique(ids, return_inverse=True)  # a set that came in two blocks is one
    label, a, b, held = np.arange(len(ids)), [], [], 0
    first = np.full(len(ids), len(ids))
    np.minimum.at(first, number, np.arange(len(ids)))
    own = first[number][owner]
    for i, j in group_pairs(start, length, n, p):
        a.append(own[i])
        b.append(own[j])
        held += len(i)
        if held > 1_000_000:
            label = joined_labels(np.concatenate([*a, np.arange(len(ids))]), np.concatenate([*b, label]), len(ids))
            a, b, held = [], [], 0
    label = joined_labels(np.concatenate([*a, np.arange(len(ids))]), np.concatenate([*b, label]), len(ids))
    moved = np.flatnonzero(label != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[label[moved]]), pa.array(ids[moved])], names=["a", "b"])


def bit_length(n: int) -> int:
    """Bits of the bitmap of a set of n: the next power of two."""
    return min(MOST_BITS, max(64, 1 << (n - 1).bit_length()))


def _bitmaps(batches):
    """Rows (doc_id, body) as (rep, node, bits), one of each pair a task: bit b is the parity of the
    shingles that fall on it."""
    seen = set()
    for batch in batches:
        ids, nodes, bits = [], [], []
        for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist())):
            node = signature_of(s)[0]
            if (doc_id, node) in seen:
                continue
            seen.add((doc_id, node))
            b = bit_length(len(s))
            odd = np.bincount((s & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1
            ids.append(doc_id)
            nodes.append(node)
            bits.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary())], names=["rep", "node", "bits"])


def near_bitmaps(bits: list[bytes], n: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Arrays (i, j) of the pairs of left and right sets that may be linked: where bitmaps differ,
    sets differ, so their overlap is at most half of their sizes less the bits that differ."""
    by_width: dict[int, np.ndarray] = {}
    for of in (left, right):
        for w in {len(bits[i]) for i in of}:
            by_width.setdefault(w, None)

    def rows(of, width):
        """The bitmaps folded to ``width`` bytes."""
        out = np.empty((len(of), width // 8), dtype=np.uint64)
        for r, i in enumerate(of):
            words = np.frombuffer(bits[i], dtype=np.uint64)
            out[r] = np.bitwise_xor.reduce(words.reshape(-1, width // 8), axis=0)
        return out

    for w in by_width:
        a = np.array([i for i in left if len(bits[i]) == w], dtype=np.int64)
        for v in by_width:
            b = np.array([i for i in right if len(bits[i]) == v], dtype=np.int64)
            if not len(a) or not len(b) or not w // 2 <= v <= w * 2:
                continue
            width = min(v, w)
            x, y = rows(a, width), rows(b, width)
            for r in range(len(a)):
                differ = np.bitwise_count(y ^ x[r]).sum(axis=1, dtype=np.int64)
                n1, n2 = n[a[r]], n[b]
                ok = (DENOMINATOR * np.minimum(n1, n2) >= NUMERATOR * np.maximum(n1, n2)) & ((n1 + n2 - differ) // 2 >= needed(n1, n2)) & (b != a[r])
                if ok.any():
                    yield np.full(int(ok.sum()), a[r]), b[ok]


def by_block(batches, done):
    """``done`` of the rows of each block; rows come sorted by block, which is the first column.  Of
    rows that repeat the side and node (the next two) the first counts: other tasks sent them too."""
    held, block = {}, None
    for batch in batches:
        for key, *row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns))):
            if key != block and held:
                yield from done([*held.values()])
                held = {}
            block = key
            held.setdefault((row[0], row[1]), row)
    if held:
        yield from done([*held.values()])


def _refined(batches):
    """Rows (block, side, node, n_shingles, bits) by block: a forest of the pairs that may be linked."""

    def done(rows):
        sides, ids, n, bits = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows]
        within = sides.min() == sides.max()
        left, right = (np.arange(len(rows)),) * 2 if within else (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1))
        pairs = list(near_bitmaps(bits, n, left, right))
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs))
            label = joined_labels(a, b, len(rows))
            moved = np.flatnonzero(label != np.arange(len(rows)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(ids[label[moved]]), pa.array(ids[moved])], names=["a", "b"])

    yield from by_block(batches, done)


def trie_links(sets: list[np.ndarray], size: np.ndarray, probes: np.ndarray, stored: np.ndarray):
    """Linked pairs (probe, stored set), by a walk of the prefix tree of the stored sets.

    sets: the tokens of each that others have too, as numbers, in the global order; size: of the
    whole sets; probes, stored: indexes of sets."""
    shared = np.array([len(s) for s in sets], dtype=np.int64)
    token = np.concatenate([sets[p] for p in probes])
    holder = np.repeat(np.arange(len(probes)), shared[probes])
    by = np.argsort(token, kind="stable")
    holder = holder[by]
    # postings of the probes: those that hold token t are holder[edge[t]:edge[t + 1]]
    edge = np.searchsorted(token[by], np.arange(max((int(s.max()) for s in sets if len(s)), default=-1) + 2))
    n, most = size[probes], shared[probes]
    least_any = -(-NUMERATOR * n // DENOMINATOR)  # needed with the smallest set that can be linked
    listed = sorted(stored.tolist(), key=lambda i: sets[i].astype(">u4").tobytes())
    common = [0] * len(listed)  # shared with the set before in the list
    for j in range(1, len(listed)):
        a, b = sets[listed[j - 1]], sets[listed[j]]
        m = min(len(a), len(b))
        unlike = np.flatnonzero(a[:m] != b[:m])
        common[j] = int(unlike[0]) if len(unlike) else m
    # the walk: a stack of nodes (depth, probes still in reach, their overlaps so far)
    stack = [(0, np.arange(len(probes)), np.zeros(len(probes), dtype=np.int64))]
    for j, i in enumerate(listed):
        while stack[-1][0] > common[j]:
            stack.pop()
        depth, alive, overlap = stack[-1]
        length = int(shared[i])
        # nodes end where a later set of the list branches off
        ends, least = {length}, length
        for later in range(j + 1, min(j + 65, len(listed))):
            least = min(least, common[later])
            if least <= depth:
                break
            ends.add(least)
        for end in sorted(ends):
            if end <= depth:
                continue
            lists = [holder[edge[t] : edge[t + 1]] for t in sets[i][depth:end].tolist()]
            overlap = overlap + np.bincount(np.concatenate(lists), minlength=len(probes))[alive]
            # what the rest of each probe, and at a leaf of the set, can still add; below a node
            # that others share the set may be any that is large enough
            rest = most[alive] - overlap
            keep = overlap + np.minimum(rest, length - end) >= needed(n[alive], size[i]) if end == length else overlap + rest >= least_any[alive]
            alive, overlap, depth = alive[keep], overlap[keep], end
            if end < length:
                stack.append((depth, alive, overlap))
        for p in alive[overlap >= needed(n[alive], size[i])].tolist():
            yield int(probes[p]), i


def _verified(batches, sketch):
    """Rows (block, side, node, copies, text) by block: links of each block, as a forest and counts."""

    def done(rows):
        sides = np.array([r[0] for r in rows])
        ids, copies = [r[1] for r in rows], [r[2] for r in rows]
        raw = [ordered(s, sketch) for s in shingle_sets([r[3] for r in rows])]
        # only tokens of two sets or more can be common; the others count in the sizes alone
        _, numbers, counts = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
        numbers, shared = numbers.astype(np.int64), counts > 1
        cuts = np.cumsum([0, *(len(s) for s in raw)])
        sets = [numbers[a:b] for a, b in zip(cuts, cuts[1:])]
        size = np.array([len(s) for s in sets])
        sets = [s[shared[s]] for s in sets]
        within = sides.min() == sides.max()
        stored, probes = (np.arange(len(rows)),) * 2 if within else (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1))
        links, parent, out = [0] * len(rows), list(range(len(rows))), []

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in trie_links(sets, size, probes, stored):
            if a == b or within and a > b:
                continue
            links[a] += copies[b]
            links[b] += copies[a]
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((ids[a], ids[b], None))
        out += [(i, None, k) for i, k in zip(ids, links) if k]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "links"])

    yield from by_block(batches, done)


def _once(batches):
    """Rows (block, side, node, ...), of which a task sends those of equal places once."""
    seen = set()
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("block", "side", "node"))))
        new = [k not in seen and not seen.add(k) for k in keys]
        yield batch.filter(pa.array(new))


def seated(families: DataFrame, classes: DataFrame, weight: F.Column, limit: int, total: int) -> tuple[DataFrame, DataFrame]:
    """The classes of each family in blocks of about ``limit`` by ``weight``, in order of size, once
    for each block that theirs can have links with: rows (node, rep, rep_h, n_shingles, copies, block,
    side); and the classes of all families, each once.

    A family within the limit is one block.  A larger one is cut by size classes (each a twentieth
    wider than the one before, so there are some hundreds at most), whose weights are partial sums; only
    these go through a window.  A size class that is too large for a block is dealt by hash."""
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(math.log(1.05))).cast("int")
    own = families.select("node", F.col("component").alias("family")).join(classes.select("node", "rep", "rep_h", "n_shingles", "copies"), "node")
    members = written(own.withColumn("step", step), "members")
    lo, hi = F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi")
    steps = members.groupBy("family", "step").agg(F.sum(weight).alias("w"), F.count("*").alias("size"), lo, hi)
    family = Window.partitionBy("family")
    so_far = F.sum("w").over(family.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    cut = steps.withColumn("from", F.floor(F.coalesce(so_far, F.lit(0)) / limit)).withColumn("many", F.ceil(F.col("w") / limit))
    cut = cut.withColumn("all", F.sum("w").over(family)).where(F.col("all") > limit)
    cut = written(cut.select("family", "step", "from", "many", "size", "lo", "hi"), "steps")
    seat = lambda *key: F.concat_ws("-", *key).alias("block")
    columns = ["node", "rep", "rep_h", "n_shingles", "copies"]
    if cut.isEmpty():
        return written(members.select(*columns, seat("family", F.lit(0), F.lit(0)), F.lit(0).alias("side")), "seats"), members

    # blocks and their meetings follow from the size classes, without the members
    dealt = F.col("many") > 1
    places = F.when(dealt, F.sequence(F.col("from") + 1, F.col("from") + F.col("many"))).otherwise(F.array("from"))
    blocks = cut.select("family", F.explode(places).alias("b"), "lo", "hi", F.when(dealt, F.lit(2)).otherwise(F.col("size")).alias("size"))
    blocks = blocks.repartition("family").groupBy("family", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("size").alias("size"))
    other = blocks.select("family", F.col("b").alias("b2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    near = (F.col("hi") * DENOMINATOR >= F.col("lo2") * NUMERATOR) & (F.col("hi2") * DENOMINATOR >= F.col("lo") * NUMERATOR)
    meets = blocks.join(other, "family").where((F.col("b") < F.col("b2")) & near | (F.col("b") == F.col("b2")) & (F.col("size") > 1))
    ends = F.when(F.col("b") == F.col("b2"), F.array(F.struct("b", F.lit(0).alias("side"))))
    ends = ends.otherwise(F.array(F.struct("b", F.lit(0).alias("side")), F.struct(F.col("b2").alias("b"), F.lit(1).alias("side"))))
    meets = meets.select("family", F.col("b").alias("b1"), "b2", F.explode(ends).alias("end")).select("family", "end.b", "b1", "b2", "end.side")

    keys = ["family", "step"]
    if cut.count() <= FEW:
        placed = members.join(F.broadcast(cut.select(*keys, "from", "many")), keys, "left")
    else:
        placed = joined_by_size(members, cut.select(*keys, "from", "many", "size"), keys, "size", total)
    whole = placed.where("many is null").select(*columns, seat("family", F.lit(0), F.lit(0)), F.lit(0).alias("side"))
    b = F.col("from") + F.when(dealt, F.pmod(F.xxhash64("node"), F.col("many")) + 1).otherwise(0)
    parted = placed.where("many is not null").withColumn("b", b).join(few(written(meets, "meets")), ["family", "b"])
    return written(whole.unionByName(parted.select(*columns, seat("family", "b1", "b2"), "side")), "seats"), members


def wanted_rows(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows whose doc_id may be a class's representative; a join with their seats must follow."""
    return thinned(rows, F.xxhash64("doc_id"), members.select(F.xxhash64("rep").alias("h")))


def labelled_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """A row for each row of ``docs`` (doc_id, h, n_shingles, component_id, n_links, keeper), h being the
    text's hash and keeper the (doc_id, h) that stands for the component; and (doc_id, h, times) of
    the rows that repeat both."""
    spark = docs.sparkSession
    body = text_of(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("h"))
    first = written(rows.mapInArrow(released(_sized), "doc_id long, h long, n_shingles long, s1 long, s2 long, chunk int, counts binary"), "sized")
    chunks = first.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_summed, "chunk int, counts binary")
    summed = {r[0]: np.frombuffer(r[1], dtype=np.uint32) for r in chunks.collect()}  # 16 MB, whatever the input
    sketch = spark.sparkContext.broadcast(np.concatenate([summed[i] for i in sorted(summed)]) if summed else np.zeros(1 << SKETCH_BITS, np.uint32))

    sized = first.where("chunk is null").select("doc_id", "h", "n_shingles", "s1", "s2")
    total = sized.count()
    keys = ["n_shingles", "s1", "s2"]
    known = sized.where("n_shingles > 0 and doc_id is not null")
    again = written(sized.where("doc_id is not null").groupBy("doc_id", "h").agg(F.count("*").alias("times")).where("times > 1"), "again")
    each = known.groupBy("doc_id", *keys).agg(F.min("h").alias("h"), F.count("*").alias("times"))
    stands = F.min(F.struct("doc_id", "h"))
    classes = each.groupBy(*keys).agg(stands.alias("first"), F.count("*").alias("copies"), F.sum("times").alias("size"))
    classes = written(classes.select(*keys, F.col("s1").alias("node"), "first", F.col("first.doc_id").alias("rep"), F.col("first.h").alias("rep_h"), "copies", "size"), "classes")

    postings = classes.agg(F.sum(F.col("n_shingles") - F.ceil(F.col("n_shingles") * NUMERATOR / DENOMINATOR) + 1)).first()[0] or 0
    parts = max(4, -(-postings // PART))
    texts = rows.select("doc_id", "body")
    sent = texts.mapInArrow(released(lambda batches: _prefixes(batches, sketch.value, parts)), "part int, ids binary, sizes binary, of binary, places binary, shingles binary")
    stars = sent.repartitionById(parts, F.col("part")).mapInArrow(released(_stars), "a long, b long")
    families = components(written(stars, "stars"))

    heavy = F.greatest("n_shingles", F.lit(SMALL))
    seats, members = seated(families, classes, heavy, 8 * BLOCK, total)
    bits = wanted_rows(texts, members).mapInArrow(released(_bitmaps), "rep long, node long, bits binary")
    placed = bits.join(seats, ["rep", "node"]).select("block", "side", "node", "n_shingles", "bits")
    placed = placed.repartition("block").sortWithinPartitions("block", "side", "node")
    families = components(written(placed.mapInArrow(released(_refined), "a long, b long"), "refined"))

    seats, members = seated(families, classes, heavy, BLOCK, total)
    own = (F.col("doc_id") == F.col("rep")) & (F.col("h") == F.col("rep_h"))
    placed = wanted_rows(rows, members).join(seats, own).select("block", "side", "node", "copies", "body")
    if not again.isEmpty():  # rows are repeated: a task sends each once
        placed = placed.mapInArrow(_once, placed.schema)
    placed = placed.repartition("block").sortWithinPartitions("block", "side", "node")
    found = written(placed.mapInArrow(released(lambda batches: _verified(batches, sketch.value)), "a long, b long, links long"), "links")

    joined = components(found.where("b is not null").select("a", "b"))
    links = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    with_links = classes.join(joined, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    with_links = written(with_links, "linked")
    least = with_links.groupBy("component").agg(F.min("first").alias("keeper"), F.count("*").alias("members"))
    labelled = joined_by_size(with_links, written(least, "least"), ["component"], "members", total)
    labelled = written(labelled.select(*keys, "size", "keeper", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "labelled")
    rest = sized.where("n_shingles = 0 or doc_id is null").select("*", F.lit(None).cast(labelled.schema["keeper"].dataType).alias("keeper"), F.lit(0).cast("long").alias("n_links"))
    out = joined_by_size(known, labelled, keys, "size", total).drop("size").unionByName(rest)
    out = out.select("doc_id", "h", "n_shingles", F.coalesce("keeper.doc_id", "doc_id").alias("component_id"), "n_links", "keeper")
    return out, again


def shingle_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, n_links."""
    with small_batches(docs.sparkSession):
        return labelled_rows(docs, doc_id, text)[0].select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (of rows of that id with
    different texts, that of the least text hash), and one of rows equal in id and text; rows without
    id or without words stay otherwise; all columns stay."""
    with small_batches(docs.sparkSession):
        labelled, again = labelled_rows(docs)
    pair = F.struct("doc_id", "h")
    gone = written(labelled.where(F.col("keeper").isNotNull() & (pair != F.col("keeper"))).select(pair.alias("gone")), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("h")).alias("key"))
    kept = without(rows, F.col("key"), gone)
    if not again.isEmpty():
        flags = marked(kept, F.xxhash64("key.doc_id", "key.h"), again.select(F.xxhash64("doc_id", "h").alias("h")))
        repeated = F.col("_may") & F.col("key.doc_id").isNotNull()
        kept = flags.where(~repeated).unionByName(flags.where(repeated).dropDuplicates(["key"]))
    return kept.select("row.*")


def op2_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_classes(documents(spark, sf_dir))


QUERIES = {"op2_shingle_join": op2_shingle_join}
ORACLES = {
    "op2_shingle_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
  common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
  reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(y) FROM reach WHERE x = d.doc_id), d.doc_id)) AS component_id,
  (SELECT count(*) FROM links WHERE x = d.doc_id) AS n_links FROM documents d LEFT JOIN sizes USING (doc_id)"""
}
