"""Ball hashing, the packed R-tree and the prefix trie against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from warraq.llm import ball_hash, hard_negatives, prefix_trie

# SimHash fingerprints


def print_by_hand(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def classes_by_hand(rows):
    """(fingerprint, component, links) of rows (id, text); rows of one id with different prints are documents of their own."""
    docs = sorted({(i, print_by_hand(t)) for i, t in rows if i is not None})
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(docs)
    for a in range(len(docs)):
        for b in range(a):
            if (docs[a][1] ^ docs[b][1]).bit_count() <= 2:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {(i, p): (docs[root(k)][0], links[k]) for k, (i, p) in enumerate(docs)}


def test_near_classes(docs, local, none):
    got = ball_hash.near_classes(docs).collect()
    want = classes_by_hand(local)
    assert len(got) == len(local)
    for r in got:
        key = (r.doc_id, int(r.fingerprint, 16))
        assert (r.component_id, r.n_links) == (want[key] if r.doc_id is not None else (None, 0))
    prints = {(r.doc_id, r.fingerprint) for r in got}
    assert prints == {(i, f"{print_by_hand(t):016x}") for i, t in local}
    assert ball_hash.near_classes(none).collect() == []


def test_every_pair_within_two_bits_meets_once(spark):
    """Dense neighbourhoods, the top bit, and zero."""
    rng = random.Random(5)
    seeds = [0, (1 << 64) - 1, 1 << 63, rng.getrandbits(64)]
    prints = {s ^ sum(1 << b for b in rng.sample([*range(4), 31, 32, 62, 63], rng.randrange(5))) for s in seeds for _ in range(40)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = [tuple(r) for r in ball_hash.near_pairs(spark.createDataFrame([(signed(p),) for p in prints], "print long")).collect()]
    want = {(signed(a), signed(b)) for a in prints for b in prints if (a ^ b).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if a < b}


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    monkeypatch.setattr(ball_hash, "CHUNK", 100)
    assert ball_hash.fingerprint(text) == print_by_hand(text)


# hard negatives


def mined_by_hand(rows, every, positives=5, negatives=5):
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a)
        for minus, p, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus]
            out += [(a, p, k + 1, i, -minus, -s) for k, (s, i, _) in enumerate(fits[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("scale", [20, 10**6, 3 * 10**8])
def test_hard_negatives_with_ties_and_a_common_vector(spark, monkeypatch, scale):
    """Small leaves and parts, a vector that a third of all rows have, and scores beyond what doubles hold."""
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rng = np.random.default_rng(scale % 97)
    rows = []
    for i in range(600):
        v = [1, -2, 3, 0, 1] if i % 3 == 0 else rng.integers(-3, 4, 5).tolist()
        rows.append((i, int(rng.integers(0, 4)), [int(x) * scale + (int(rng.integers(0, 2)) if scale > 20 else 0) for x in v]))
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").repartition(5)
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 25 == 0).collect()))
    assert got == mined_by_hand(rows, 25)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [0.5, 0.25], "x"), (1, 1, [0.5, 0.25], "x"), (1, 1, [0.5, 0.25], "x"), (1, 2, [9.0, 9.0], "x"), (2, 2, [0.5, 0.24], "x"), (3, 2, [0.45], "x"), (4, 2, [], "x"),
        (5, None, [0.5, 0.5], "x"), (6, 1, None, "x"), (7, 1, [0.5, None], "x"), (8, 1, [nan, 0.5], "x"), (9, 1, [inf, 0.5], "x"), (None, 1, [0.5, 0.5], "x"), (10, 2, [0.5, 0.25], None),
    ]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, v string")
    got = hard_negatives.hard_negatives(hard_negatives.integer_vectors(table), F.col("vec_id") == 0).collect()
    # the row of id 1 is the least by label; the shorter vector has a zero, and its score is just in the window
    assert sorted(map(tuple, got)) == [(0, 1, 1, 10, 20480, 20480), (0, 1, 2, 2, 20480, 20288)]
    none = hard_negatives.hard_negatives(hard_negatives.integer_vectors(table.where("false")), F.col("vec_id") == 0)
    assert none.collect() == [] and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_boxes_out_of_reach_are_not_opened():
    rng = np.random.default_rng(2)
    rows = np.repeat(rng.integers(-1000, 1000, (40, 6)), 200, axis=0) + rng.integers(-2, 3, (8000, 6))
    tree = hard_negatives.Tree(np.arange(8000), np.zeros(8000, dtype=np.int64), rows)

    class Counted(np.ndarray):
        opened = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Counted.opened += 1
            return np.asarray(self)[at]

    tree.ids = tree.ids.view(Counted)
    found = list(tree.searched(rows[:1], [-1], [0], [[(None, None, None, None)]], True, 5))
    want = sorted((-int(s), i) for i, s in enumerate(rows @ rows[0]))[:5]
    assert [(-s, i) for _, _, s, i in found] == want and Counted.opened < len(tree.levels[0][2]) / 4


# prefixes of conversations


def nodes_by_hand(rows):
    """Rows (conv_id, turn, role, text) with different turns, by plain sets of prefixes."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, p in built.items():
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].add(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(x[: len(q)] == q and len(x) == len(q) + 1 for x in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children, len(leaves), saved, sha))
    return sorted(out, key=repr)


def talks(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), n):
        common = rng.random() < 0.5
        for turn in range(rng.randrange(1, 14)):
            said = ("a", f"t{turn}é") if common and rng.random() < 0.9 else (rng.choice(["user", None, ""]), rng.choice([None, "", "x", "yy"]))
            rows.append((c, turn if turn else None, *said))
    return rows


@pytest.mark.parametrize("segment, batch", [(1024, 200_000), (3, 7), (1, 1)])
def test_prefix_nodes(spark, monkeypatch, segment, batch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "BATCH", batch)
    monkeypatch.setattr(prefix_trie, "RANGE_BITS", 4)
    monkeypatch.setattr(prefix_trie, "LARGE", 3)
    rows = talks(segment)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(None, 1, "a", "b", "x", 1)], "conv_id long, turn long, role string, text string, digest string, pos int").repartition(6)
    got = sorted(map(tuple, prefix_trie.prefix_nodes(table).collect()), key=repr)
    assert got == nodes_by_hand(rows)


def test_tables_without_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_nodes(none).collect() == []


def test_tries_find_exit_nodes():
    rng = random.Random(9)
    words = [tuple(rng.choice("ab") for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    digest = {"a": (1, 2), "b": (3, 4)}
    with np.errstate(over="ignore"):
        made = [prefix_trie.Word(np.array([digest[x] for x in w], dtype=np.uint64).reshape(-1, 2), np.ones(len(w), dtype=np.int64)) for w in words]
        trie = prefix_trie.ZFastTrie(made[0])
        for i, w in enumerate(made):
            trie.insert(w, i, True)
        trie.counted()
    prefixes = {w[:d] for w in words for d in range(len(w) + 1)}
    assert sum(trie.end[n] - trie.top[n] for n in range(len(trie.top))) == len(prefixes)
    assert trie.passing[0] == len(words) and trie.least[0] == 0
    for w, x in zip(words, made):
        node = trie.exit_node(x)
        assert node == 0 or trie.word[node].at(trie.end[node]) == x.at(trie.end[node])
    assert all(trie.table[trie.handle(n)] == n for n in range(1, len(trie.top)))
    assert [prefix_trie.two_fattest(*x) for x in ((0, 1), (0, 7), (4, 7), (5, 7), (8, 12), (8, 11), (6, 7))] == [1, 4, 6, 6, 12, 10, 7]
