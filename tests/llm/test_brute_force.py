"""The operators against computations of their own, written plainly and apart from theirs."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from warraq.llm import common, exact_dedup, mixture, packing, phrase_print, ppm, quality, secret_scan, shards, shingle_join, token_count


def text_of(t):
    return t or ""


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# filters


def test_filters_grow_with_their_keys(spark):
    """About the same share of other rows gets through at 1,000 and at 300,000 keys."""
    rows = spark.range(1_000_000, 1_050_000)
    shares = []
    for n in (1_000, 300_000):
        keys = spark.range(n).select(F.xxhash64("id").alias("h"))
        assert common.thinned(spark.range(min(n, 5_000)), F.xxhash64("id"), keys).count() == min(n, 5_000)
        shares.append(common.thinned(rows, F.xxhash64("id"), keys).count() / 50_000)
    assert max(shares) < 0.1
    assert common.filter_bits(10_000_000_000) is None


@pytest.mark.parametrize("most", [15, 10])
def test_rows_beyond_a_filter_are_exact(spark, most):
    """With a filter that is full, and without any, the same rows stay."""
    gone = spark.range(0, 4_000, 2).select("id")
    got = common.without(spark.range(4_000), F.col("id"), gone, most)
    assert sorted(r.id for r in got.collect()) == list(range(1, 4_000, 2))


def test_small_batches_end(spark):
    before = spark.conf.get(common.ARROW_KEY)
    with common.small_batches(spark, 7):
        assert spark.conf.get(common.ARROW_KEY) == "7"
    assert spark.conf.get(common.ARROW_KEY) == before


# mixture


def by_hand(cells, targets, rounds=2000):
    """Raking as loops over dictionaries, and the factor by bisection."""
    weight, total = dict.fromkeys(cells, 1.0), sum(cells.values())
    for _ in range(rounds):
        for m in range(3):
            have = Counter()
            for c, t in cells.items():
                have[c[m]] += t * weight[c]
            for c in cells:
                if have[c[m]]:
                    weight[c] *= targets[m][c[m]] * total / have[c[m]]
    low, high = 0.0, 1e9
    for _ in range(200):
        f = (low + high) / 2
        got = sum(t * min(1, f * weight[c]) for c, t in cells.items())
        low, high = (f, high) if got < mixture.SHARE * total else (low, f)
    return {c: (w, min(1, high * w)) for c, w in weight.items()}


def mixed(docs, **how):
    columns = ["doc_id", *(f"mix_{c}" for c in ("source", "lang", "topic", "n_tokens", "weight", "probability", "error", "sampled"))]
    return mixture.mixture(docs, **how).select(*columns).collect()


@pytest.mark.parametrize("stated", [{}, {"lang": {"en": 0.6}, "source": {"a": 0.3, "b": 0.3}}])
def test_weights_of_a_corpus(spark, stated):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice("abcd"), rng.choice(["en", "fr", None]), rng.choice("xy")) for i in range(600)]
    docs = frame(spark, rows, "doc_id long, text string, source string, lang string, kind string")
    cells = Counter()
    for _, text, source, lang, kind in rows:
        cells[source, lang or "", kind] += len(text.split())
    total, targets = sum(cells.values()), []
    for m, name in enumerate(mixture.MARGINS):
        have = Counter()
        for c, t in cells.items():
            have[c[m]] += t
        own = stated.get(name, {})
        rest = {k: v ** mixture.FLATTEN[name] for k, v in have.items() if k not in own}
        targets.append(own | {k: v / sum(rest.values()) * (1 - sum(own.values())) for k, v in rest.items()})
    want = by_hand(cells, targets, 300)
    got = mixed(docs, topic=F.col("kind"), targets=stated)
    for r in got:
        w, p = want[r.mix_source, r.mix_lang, r.mix_topic]
        assert math.isclose(r.mix_weight, w, rel_tol=1e-6) and math.isclose(r.mix_probability, p, rel_tol=1e-6) and r.mix_error < 1e-8
    assert abs(sum(r.mix_n_tokens * r.mix_probability for r in got) - mixture.SHARE * total) < 1e-6 * total
    drawn = sum(r.mix_n_tokens for r in got if r.mix_sampled)
    assert abs(drawn - mixture.SHARE * total) < 0.08 * total
    assert all(r.mix_sampled for r in got if r.mix_probability == 1)


def test_both_ways_of_raking_agree(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice("abc"), rng.choice(["en", "fr"]), rng.choice("xy")) for i in range(200)]
    docs = frame(spark, rows, "doc_id long, text string, source string, lang string, kind string")
    how = {"topic": F.col("kind"), "targets": {"lang": {"en": 0.5}}}
    near, far = ({r.doc_id: r for r in mixed(docs, **how, max_cells=n)} for n in (1000, 0))
    for i, r in near.items():
        assert math.isclose(r.mix_weight, far[i].mix_weight, rel_tol=1e-9) and math.isclose(r.mix_probability, far[i].mix_probability, rel_tol=1e-9)
        assert r.mix_sampled == far[i].mix_sampled and abs(r.mix_error - far[i].mix_error) < 1e-12


@pytest.mark.parametrize("max_cells", [1000, 0])
def test_targets_that_cannot_be_met_are_reported(spark, max_cells, monkeypatch):
    monkeypatch.setattr(mixture, "ROUNDS", 3)
    docs = frame(spark, [(1, "a b", "s", "en"), (2, "c d", "t", "en")], "doc_id long, text string, source string, lang string")
    got = mixed(docs, targets={"lang": {"en": 0.5, "xx": 0.5}}, max_cells=max_cells)
    assert all(abs(r.mix_error - 0.5) < 1e-9 for r in got) and len(got) == 2
    assert mixed(docs.limit(0), max_cells=max_cells) == []


def test_topics(spark):
    texts = {"a | b": "table", "a ### b": "symbols", "a!!": "shouting", "the LICENCE says": "licence", "x@y.org": "contact", "http://x": "web", "two\n- one\n- two": "list", "Ann: yes": "dialogue", "f();": "code", "why?": "question", "": "empty", "few words": "note", "w " * 500: "article", "w " * 2000: "long read"}
    rows = frame(spark, list(enumerate(texts)))
    got = rows.select("text", mixture.topic_of(F.col("text"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("t")).collect()
    assert {r.text: r.t for r in got} == texts


def test_rows_without_id_share_a_draw(spark):
    rows = [(None, f"some words {'x ' * (i % 5)}", "s", "en") for i in range(50)]
    got = mixed(frame(spark, rows, "doc_id long, text string, source string, lang string"))
    assert len({r.mix_sampled for r in got if r.mix_probability == got[0].mix_probability}) == 1 and len(got) == 50


# shingles


def near_by_hand(rows):
    """(doc_id, text) to (component, links) over distinct (id, set) documents, every pair looked at."""

    def shingles(t):
        w = text_of(t).encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    nodes = sorted({(i, shingles(t)) for i, t in rows if i is not None and shingles(t)}, key=lambda x: (x[0], sorted(x[1])))
    links = {n: [m for m in nodes if m != n and 100 * len(n[1] & m[1]) >= 75 * len(n[1] | m[1])] for n in nodes}
    out = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out[n] = (min(i for i, _ in seen), len(links[n]))
    return [(i, len(shingles(t)), *(out.get((i, shingles(t)), (i, 0)))) for i, t in rows]


def clashing_rows():
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w59", "other")
    far = " ".join(f"v{i}" for i in range(30))
    return [(1, base), (1, base), (2, near), (3, base.replace("w0 ", "first ")), (5, far), (5, near), (6, far.upper()), (7, ""), (7, None), (8, far), (8, far), (None, far), (None, ""), (9, "one two"), (10, "ONE  two")]


def test_repeated_rows_and_clashing_ids(spark):
    rows = clashing_rows()
    want = Counter(near_by_hand(rows))
    got = shingle_join.shingle_classes(frame(spark, rows).repartition(5)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == want


def test_one_of_each_keeps_texts_of_clashing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "a b c d e f"), (0, "A B C D E F"), (3, ""), (3, ""), (None, "a b c d e f"), (4, "z y"), (4, "z y")]
    kept = shingle_join.one_of_each(frame(spark, rows)).collect()
    # id 0 stands for its text's group; the other text of id 1 has no group and stays; equal rows once
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(0, "A B C D E F"), (1, "p q r s t u"), (3, ""), (None, "a b c d e f"), (4, "z y")])


def test_families_of_many_sizes_in_small_blocks(spark, monkeypatch):
    """Size classes that are cut and dealt, blocks that meet, and repeated rows at once."""
    monkeypatch.setattr(shingle_join, "BLOCK", 400)
    monkeypatch.setattr(shingle_join, "SMALL", 20)
    rng, rows = random.Random(3), []
    for k in range(70):
        n = rng.randrange(40, 75)
        w = [f"w{i}" for i in range(n)]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(n)] = f"x{rng.randrange(9)}"
        rows += [(k, " ".join(w))] * rng.choice([1, 1, 2])
    got = shingle_join.shingle_classes(frame(spark, rows).repartition(6)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == Counter(near_by_hand(rows))


def test_shuffles_of_small_tables(spark):
    """Without adaptive merging each shuffle is so many tasks: graphs that a task can hold take none,
    and what is known of blocks is not shuffled again (49 shuffled stages before, 14 now)."""
    rows = clashing_rows()
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    sc, tracker, group = spark.sparkContext, spark.sparkContext.statusTracker(), f"shuffles-{random.random()}"
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sc.setJobGroup(group, group)
        got = shingle_join.shingle_classes(frame(spark, rows).coalesce(2)).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in keep.items():
            spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    shuffled = [s for s in stages if (i := tracker.getStageInfo(s)) and i.numTasks == 13 and i.numCompletedTasks]
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == Counter(near_by_hand(rows))
    assert 0 < len(shuffled) <= 25


def test_blocks_meet_by_shuffle_and_by_broadcast(spark, monkeypatch):
    """Size classes and meetings of blocks give the same whether they are few enough to be broadcast or not."""
    monkeypatch.setattr(shingle_join, "BLOCK", 300)
    monkeypatch.setattr(shingle_join, "SMALL", 20)
    rng, rows = random.Random(5), []
    for k in range(60):
        w = [f"w{i}" for i in range(rng.randrange(40, 75))]
        w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, f"pair {k // 2} of a small family that fits in one block by itself") for k in range(6)]
    want = Counter(near_by_hand(rows))
    for few in (0, 100_000):
        monkeypatch.setattr(shingle_join, "FEW", few)
        monkeypatch.setattr(shingle_join, "few", lambda df, few=few: common.few(df, few))
        got = shingle_join.shingle_classes(frame(spark, rows).repartition(6)).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == want


def test_graphs_beyond_one_task(spark, monkeypatch):
    """Graphs of more edges than a task takes: the same components by rounds."""
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(-5, 600), (600, -9), (3, 3)]
    label = {i: i for e in edges for i in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    alone = {i for i in label if not any(i in e and e[0] != e[1] for e in edges)}
    want = {i: c for i, c in label.items() if i not in alone}
    for most in (40, 1_000_000):
        monkeypatch.setattr(common, "EDGES", most)
        got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_forest_in_slices():
    """A task's edges in slices keep together what they join, whatever it may hold at once."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(-500, 500, (2, 900))
    edges = [common.pa.RecordBatch.from_arrays([common.pa.array(x), common.pa.array(y)], names=["a", "b"]) for x, y in zip(np.split(a, 30), np.split(b, 30))]

    def pieces(x, y):
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        label = common.joined_labels(at[: len(x)], at[len(x) :], len(nodes))
        return {n: nodes[c] for n, c in zip(nodes.tolist(), label.tolist()) if n != nodes[c] or (label == c).sum() > 1}

    for most in (50, 300, 10_000):
        out = [(r.column(0).to_numpy(), r.column(1).to_numpy()) for r in common._forest(iter(edges), most)]
        assert pieces(*(np.concatenate(x) for x in zip(*out))) == pieces(a, b)
        assert most < 10_000 or len(out) == 1


# fingerprints


def plain_print(text):
    """LZ78 phrases and their 64 minima with whole numbers of Python."""
    full = (1 << 64) - 1

    def spread(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & full
        return x ^ x >> 31

    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    base, out = 0x9E3779B97F4A7C15, []
    hashes = [spread((sum(spread(ord(c) + 1) * pow(base, k, 1 << 64) for k, c in enumerate(p)) + len(p)) & full) for p in seen]
    numbers = [spread(k) for k in range(1, 129)]
    for a, b in zip(numbers[:64], numbers[64:]):
        if hashes:
            out.append(spread(min((h * (a | 1) + b) & full for h in hashes)) & 0xFFFF)
    return out


def alike(a, b):
    return float(not a and not b) if not a or not b else sum(x == y for x, y in zip(a, b)) / 64


@pytest.mark.parametrize("parts", [1, 5])
def test_prints_by_hand(spark, parts):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab cdé🙂") for _ in range(rng.randrange(40))) for _ in range(25)] + [None, "", "abcabcabcabcabc", "abcabcabcabcabd"]
    rows = [(i * 7, t) for i, t in enumerate(texts)]
    prints = [plain_print(text_of(t)) for t in texts]
    got = {r.doc_id: r for r in phrase_print.phrase_prints(frame(spark, rows).repartition(parts)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        own, after = text_of(t), text_of(texts[(k + 1) % len(texts)])
        edited = own[: len(own) - len(own) // 4] + after[: len(own) // 4]
        r = got[i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x:04x}" for x in prints[k]) and r.edited_fingerprint == "".join(f"{x:04x}" for x in plain_print(edited))
        assert r.near_edited == alike(prints[k], plain_print(edited)) and r.near_next == alike(prints[k], prints[(k + 1) % len(texts)])


def test_prints_of_one_row_and_of_rows_without_id(spark):
    one = phrase_print.phrase_prints(frame(spark, [(4, "abcdefgh")])).collect()
    assert len(one) == 1 and one[0].near_next == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    rows = [(None, f"text {i} of none") for i in range(60)] + [(1, "x" * 9), (1, "y" * 9), (1, "x" * 9), (2, "z")]
    docs = frame(spark, rows).repartition(3)
    cells, _ = phrase_print.placed_rows(docs)
    assert cells.where("doc_id is null").select("cell").distinct().count() > 1
    got = phrase_print.phrase_prints(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    # in order of id and text hash (rows without id first), each has the next one's beginning
    placed = sorted(((r.doc_id is not None, r.doc_id or 0, r.h), r.body) for r in cells.collect())
    want = Counter()
    for k, (_, body) in enumerate(placed):
        after = placed[(k + 1) % len(placed)][1]
        want[hashlib.sha256((body[: len(body) - len(body) // 4] + after[: len(body) // 4]).encode()).hexdigest()] += 1
    assert Counter(r.edited_sha256 for r in got) == want


# secrets


def spans_by_hand(text):
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(base)


def random_text(rng):
    some = ["user: alice ", "login = bob77 ", "token: abcd1234efgh ", "https://a.example.com/x ", "AKIA" + "Q7" * 9 + " ", "AKIASHORT ", "0123456789abcdef" * 2 + " ", "deadbeef ", "Zx9kQ2mN7pL4vB8tR3wY ", "host=db.example.org ", "…é " * 60, "plain words here ", "password = \"x\" "]
    return "".join(rng.choice(some) for _ in range(rng.randrange(1, 12)))


def test_spans_and_links_by_hand(spark):
    rng = random.Random(6)
    texts = [random_text(rng) for _ in range(150)] + ["AKIA" + "B" * 60_000 + " user: alice", "a" * 100_000, None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    got = secret_scan.secret_spans(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    gap = lambda p, q: max(p[0] - q[2], q[0] - p[2], 0)
    for r in got:
        text = text_of(texts[r.doc_id])
        base = spans_by_hand(text)
        listed = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        weak = secret_scan.weak_spans(text, base)
        parts = base + weak
        close = lambda p, kinds: [q for q in parts if q[1] in kinds and q != p and gap(p, q) <= secret_scan.SCOPE]
        rule = {3: lambda p: close(p, (0, 2, 4)), 4: lambda p: close(p, (1, 3)) or close(p, (5,)), 5: lambda p: close(p, (1, 3)) and close(p, (0, 2, 4))}
        kept = [p for p in weak if rule[p[1]](p)]
        assert r.spans == listed(sorted(base + kept)) and r.n_linked == len(kept)
        rows_of = [c.split("+") for c in r.credentials.split(",") if c]
        secrets = [p for p in sorted(parts) if p[1] in (0, 2, 4) and (close(p, (1, 3)) or close(p, (5,)))]
        assert [c[1] for c in rows_of] == [f"{p[0]}:{p[2]}" for p in secrets]
        for p, (ident, _, endpoint) in zip(secrets, rows_of):
            for found, kinds in ((ident, (1, 3)), (endpoint, (5,))):
                near = close(p, kinds)
                assert (found == "-") == (not near)
                if near:
                    a, b = map(int, found.split(":"))
                    assert gap(p, (a, 0, b)) == min(gap(p, q) for q in near)


def test_credentials_name_their_parts(spark):
    text = "user: alice at https://a.example.com/x token: abcd1234efgh"
    row = secret_scan.secret_spans(frame(spark, [(1, text)])).first()
    assert row.credentials == "0:11+39:58+15:38" and row.n_linked == 2


# packing


def naive(sizes, lengths, usual):
    """Best-fit decreasing by a search over all bins; opens ``usual`` or the next length that holds the piece."""
    bins = []
    for s in sizes:
        fits = [b for b in bins if b[0] - sum(b[1]) >= s]
        if fits:
            min(fits, key=lambda b: b[0] - sum(b[1]))[1].append(s)
        else:
            bins.append((next(c for c in lengths if c >= max(usual, s)), [s]))
    return sorted(next(c for c in lengths if c >= sum(b)) for _, b in bins)


def test_plans_against_a_naive_best_fit():
    rng, lengths = random.Random(4), (8, 16, 32, 64)
    for _ in range(40):
        sizes = sorted((rng.randrange(0, 65) for _ in range(rng.randrange(1, 60))), reverse=True)
        for usual in lengths:
            plan = packing.pack_by(sizes, lengths, lambda pieces, place, _, usual=usual: next(c for c in lengths if c >= max(usual, pieces.sizes[place])))
            assert sorted(plan[2]) == naive(sizes, lengths, usual)
        best = packing.pack(sizes, lengths)
        price = lambda opened: sum(map(packing.cost, opened))
        assert price(best[2]) <= min(price(naive(sizes, lengths, u)) for u in lengths) + 1e-9


def least_cost(sizes, lengths):
    """The cost of the best packing, over all ways to part the pieces."""
    best = [math.inf]

    def place(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(packing.cost(next(c for c in lengths if c >= b)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= lengths[-1]:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


def test_small_packings_are_near_the_best():
    rng, lengths = random.Random(9), (256, 512, 1024)
    for _ in range(25):
        sizes = sorted((rng.randrange(1, 900) for _ in range(7)), reverse=True)
        got = sum(map(packing.cost, packing.pack(sizes, lengths)[2]))
        assert got <= 1.25 * least_cost(sizes, lengths)


def test_short_lengths_are_opened_where_long_ones_stay_empty():
    assert Counter(packing.pack([200] * 3)[2]) == Counter({1024: 1}) or sum(packing.pack([200] * 3)[2]) <= 1024
    _, _, opened = packing.pack([500, 500, 500])
    assert sorted(opened) == [512, 1024]


def test_ids_stay_exact_beside_null_ones(spark):
    rows = [((1 << 60) + 1, "a b c"), (None, "d e"), ((1 << 60) + 3, None), (5, "x " * 9000), (5, "x " * 9000)]
    got = packing.packed_sequences(frame(spark, rows)).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert total == Counter({(1 << 60) + 1: 3, None: 2, 5: 18000, (1 << 60) + 3: 0}) and sum(r.doc_id == 5 for r in got) == 6


def test_groups_follow_the_pieces_of_long_texts(spark, monkeypatch):
    """Four texts of 300 pieces each make as many groups as 1200 short ones."""
    monkeypatch.setattr(packing, "GROUP", 100)
    long = spark.range(4).repartition(4).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit(300 * 4096).alias("size"))
    got = packing.packed_sequences(long, tokens=F.col("size")).collect()
    groups = Counter(r.bin_id.split("-")[0] for r in got)
    assert len(got) == 1200 and len(groups) == 12 and max(groups.values()) <= 130


def test_repeated_rows_are_dealt_evenly(spark, monkeypatch):
    """Groups are of about one size where all rows are equal, and each piece is in one bin."""
    monkeypatch.setattr(packing, "GROUP", 100)
    got = packing.packed_sequences(frame(spark, [(1, "a b c d e")]).crossJoin(spark.range(1000)).repartition(3)).collect()
    groups = Counter(r.bin_id.split("-")[0] for r in got)
    assert len(groups) == 10 and max(groups.values()) <= 130
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r.bin_offset)
    assert all(sorted(x) == [5 * k for k in range(len(x))] for x in bins.values())


# language model


def test_no_training_texts(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = ppm.corpus_scores(frame(spark, [(i, "ab c") for i in held])).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and math.isclose(r.score, -5 * math.log10(256), rel_tol=1e-6) for r in got) and len(got) == 3


# quality


def test_scores_are_ratios_of_the_densities(spark):
    """The densities by determinants and inverses of covariances that numpy makes itself."""
    rng = random.Random(7)
    def text(good):
        words = [rng.choice(["the", "of", "stone", "river", "light"]) if good else rng.choice(["!!!", "#x%", "BUY", "a1"]) for _ in range(rng.randrange(5, 80))]
        return " ".join(words) + (".\n" if good else "\n") + "x" * rng.randrange(5)
    rows = [(i, text(i % 3 > 0)) for i in range(240)]
    marks = [(i, int(i % 3 > 0)) for i in range(240)] + [(0, 1), (1, None)]
    labels = frame(spark, marks, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(frame(spark, rows), labels).collect()}
    x = {i: np.array(quality.statistics(t)) for i, t in rows}
    # document 0 has a 0 and a 1: a tie counts as 0
    of = {i: int(i % 3 > 0) for i in range(240) if zlib.crc32(str(i).encode()) % 4 != 2}
    by = {c: np.array([x[i] for i in of if of[i] == c]) for c in (0, 1)}
    n = {c: len(v) for c, v in by.items()}
    own = {c: np.cov(v.T, bias=True) for c, v in by.items()}
    pooled = (own[0] * n[0] + own[1] * n[1]) / (n[0] + n[1])
    density = {}
    for c in (0, 1):
        m = (1 - quality.POOLED) * own[c] + quality.POOLED * pooled
        m = (1 - quality.DIAGONAL) * m + quality.DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(quality.D)
        inverse, (_, log_det) = np.linalg.inv(m), np.linalg.slogdet(m)
        density[c] = {i: math.log(n[c] / (n[0] + n[1])) - log_det / 2 - (v - by[c].mean(0)) @ inverse @ (v - by[c].mean(0)) / 2 for i, v in x.items()}
    for i in x:
        want = 1 / (1 + math.exp(min(700, max(-700, density[0][i] - density[1][i]))))
        assert math.isclose(got[i].score, want, rel_tol=1e-5, abs_tol=1e-12) and got[i].predicted == int(got[i].score >= 0.7)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_one_class_of_labels(spark):
    docs = frame(spark, [(i, f"text {i}") for i in range(8)])
    for label, want in ((1, 1.0), (0, 0.0), (None, 0.5)):
        labels = frame(spark, [(i, label) for i in range(8)], "doc_id long, quality int")
        assert {r.score for r in quality.quality_scores(docs, labels).collect()} == {want}


# tokens


def test_vocabulary_without_added_strings(spark, tmp_path):
    from tokenizers import Tokenizer

    contents = json.loads(token_count.vocabulary_json())
    contents["added_tokens"] = []
    path = tmp_path / "bare.json"
    path.write_text(json.dumps(contents), encoding="utf-8")
    library = Tokenizer.from_str(path.read_text(encoding="utf-8"))
    texts = ["abc def", "a<|endoftext|>b", "", None, "naïve 中文 🙂", "x" * 3000]
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(frame(spark, list(enumerate(texts))), vocabulary=str(path)).collect()}
    assert got == {i: len(library.encode(text_of(t), add_special_tokens=False).ids) for i, t in enumerate(texts)}


# exact dedup


def test_one_row_of_identical_ones_is_kept(spark):
    rows = [(1, "a"), (1, "a"), (1, "a"), (0, "a"), (2, "b"), (2, "b"), (3, "c"), (None, ""), (None, None), (None, "d"), (4, "d"), (5, "e"), (5, "f")]
    got = exact_dedup.exact_duplicates(frame(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows)
    kept = Counter((r.doc_id, r.text_sha256) for r in got if r.kept)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert kept == Counter({(i, sha(t)): 1 for i, t in [(1, "a"), (2, "b"), (3, "c"), (None, ""), (4, "d"), (5, "e"), (5, "f")]})
    left = exact_dedup.without_copies(frame(spark, rows)).collect()
    assert Counter(text_of(r.text) for r in left) == Counter("a b c d e f".split() + [""])


def test_suspects_travel_as_codes(spark, monkeypatch):
    """Many owners and senders: the prints that come back are those that occur more than once."""
    monkeypatch.setattr(exact_dedup, "OWNER_ROWS", 50)
    monkeypatch.setattr(exact_dedup, "SEND_ROWS", 70)
    rng = random.Random(3)
    values = [rng.randrange(1 << 34) for _ in range(900)]
    values += rng.sample(values, 200) + [values[0]] * 300
    rng.shuffle(values)
    _, span = exact_dedup.print_bits(len(values))
    got = exact_dedup.suspect_prints(frame(spark, [(v,) for v in values], "print long").repartition(4), 34 - 5)
    assert {r["print"] for r in got.collect()} == {v for v, n in Counter(values).items() if n > 1} and span > 0


# shards


def test_splitters_are_exact_and_refined(spark):
    """Splitters against the sorted keys; keys so close together that rounds must refine."""
    rng = random.Random(5)
    rows = [(rng.randrange(1 << 20) if i % 3 else rng.randrange(1 << 52), rng.randrange(1, 100)) for i in range(2000)]
    got, rounds = shards.histogram_splitters(frame(spark, rows, "key long, size long"), 5, 0.002)
    total = sum(s for _, s in rows)
    assert rounds > 1 and got == sorted(got)
    for k, edge in enumerate(got, 1):
        below = sum(s for key, s in rows if key < edge)
        assert abs(below - total * k / 5) <= 0.002 * total + 100


def test_shards_of_repeated_rows_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(shards, "CELL_ROWS", 20)
    rows = [(1, "same text")] * 150 + [(i, "same text") for i in range(100, 160)] + [(i, f"text {i}") for i in range(200, 260)] + [(None, None), (9, "")]
    got = shards.histogram_shards(frame(spark, rows).repartition(4), 4).collect()
    texts = dict(rows)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(r.law == "bytes" and r.grown_shard is None and r.size == len(text_of(texts[r.doc_id]).encode()) + 1 and r.text_crc32 == zlib.crc32(text_of(texts[r.doc_id]).encode()) for r in got)
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"same text")}) == 1
    for s in range(4):
        own = [r.slot for r in got if r.shard == s]
        assert sorted(own) == list(range(len(own)))


# the pipeline


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empties, ties, repeated rows and extra columns pass through each stage as its docstring says."""
    import corpus_pipeline

    good = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, good, "en", "a", 1, "x"), (1, good, "en", "a", 1, "x"), (2, good, None, None, None, None), (3, good + " more", "en", "a", 1, "x"), (None, "other words of a text that stands alone here.", "en", "a", 1, "x"), (4, None, "en", "a", 0, "x"), (5, "", "en", "a", 0, "x"), (5, "", "en", "a", 0, "x")]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    frame(spark, [(1, 1), (2, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for part in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before, part = part, stage(spark, part, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert part.columns == docs.columns and part.count() <= before.count()
            if name == "exact dedup":
                assert Counter(text_of(r.text) for r in part.collect()) == Counter({text_of(r.text) for r in before.collect()})
            if name == "n-gram Jaccard join" and part.count():
                assert Counter(r.doc_id for r in part.collect() if r.text and r.text.startswith("word0")) == Counter([2])
    assert set(corpus_pipeline.run(spark, str(tmp_path)).columns) >= {"doc_id", "bin_id", "n_tokens"}


def test_every_pair_is_looked_at():
    """group_pairs yields the possible pairs of each group, and no others."""
    rng = np.random.default_rng(0)
    n, p = rng.integers(5, 60, 90), rng.integers(0, 5, 90)
    start, length = np.array([0, 3, 45]), np.array([3, 42, 45])
    for a, k in zip(start, length):
        n[a : a + k] = np.sort(n[a : a + k])
    want = {(i, j) for a, k in zip(start, length) for i, j in itertools.combinations(range(a, a + k), 2) if shingle_join.possible(*(np.array([x]) for x in (n[i], p[i], n[j], p[j])))[0]}
    got = {(int(i), int(j)) for x, y in shingle_join.group_pairs(start, length, n, p) for i, j in zip(x, y)}
    assert got == want
