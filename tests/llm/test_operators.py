"""The operators against brute force, a round trip or held-out accuracy."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from warraq import llm
from warraq.llm import common, exact_dedup, mixture, packing, phrase_print, ppm, quality, secret_scan, shards, shingle_join, token_count
from warraq.llm.common import components

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def text_of(t):
    return t or ""


# exact dedup


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        values = np.unique(rng.integers(0, 1 << 34, n))
        for k in (0, 5, 20, 34) if n < 3 else (22, 25):
            assert np.array_equal(exact_dedup.golomb_decode(exact_dedup.golomb_code(values, k), len(values), k), values)


def test_exact_duplicates(docs, local):
    got = exact_dedup.exact_duplicates(docs).collect()
    groups = defaultdict(list)
    for i, t in local:
        groups[text_of(t)].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(got) == len(local)
    for r in got:
        t = by_hash[r.text_sha256]
        assert (r.keep_id, r.group_size) == (best[t], len(groups[t]))
    assert sum(r.kept for r in got) == len(groups)


def test_without_copies(docs, none, local):
    got = exact_dedup.without_copies(docs)
    assert got.columns == docs.columns
    assert Counter(text_of(r.text) for r in got.collect()) == Counter({text_of(t) for _, t in local})
    assert exact_dedup.without_copies(none).collect() == []


# shards


def test_shards(docs, local, none):
    rows = shards.histogram_shards(docs).collect()
    assert len(rows) == len(local) and {r.shard for r in rows} <= set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.size == len(text_of(dict(local)[r.doc_id]).encode()) + 1 for r in rows if r.doc_id is not None)
    assert all(len({r.shard for r in rows if r.text_crc32 == c}) == 1 for c in {r.text_crc32 for r in rows})
    assert shards.histogram_shards(none).collect() == []


def test_shards_are_balanced(spark):
    rows = shards.histogram_shards(spark.read.parquet(f"{os.path.dirname(SF)}/sf0.1/documents.parquet")).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    groups = Counter()
    for r in rows:
        groups[r.text_crc32] += r.size
    largest = max(groups.values())
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * mean + 2 * largest


# tokens


def test_token_counts(docs, local, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_count.vocabulary_path())
    got = {r.doc_id: r for r in token_count.token_counts(docs).collect()}
    for i, t in local:
        assert got[i].n_tokens == len(library.encode(text_of(t), add_special_tokens=False).ids) and got[i].n_bytes == len(text_of(t).encode())
    assert token_count.token_counts(none).collect() == []


def test_token_counts_of_odd_texts(spark):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(token_count.vocabulary_path()), random.Random(3)
    texts = ["".join(rng.choice(["a", "Z", "9", " ", "\n", "\t", "'s", "é", "—", "🙂", "中", " ", "<|endoftext|>", "ing", "!!"]) for _ in range(rng.randrange(200))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_count.token_counts(rows).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


# shingles


def sets_of(local):
    out = {}
    for i, t in local:
        w = [x.decode() for x in text_of(t).encode().lower().split()]
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    return out


def brute_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_shingle_classes(docs, local, none):
    got = shingle_join.shingle_classes(docs).collect()
    known = [(i, t) for i, t in local if i is not None]
    sets = sets_of(known)
    want = brute_components(sets)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, len(sets[i]), want[i]) for i in sets}
    assert [r.component_id for r in got if r.doc_id is None] == [None] and len(got) == len(local)
    assert shingle_join.shingle_classes(none).collect() == []


def test_near_copies_of_one_text(spark):
    """A family whose members are on both sides of the threshold, in blocks of a few."""
    rng, base = random.Random(5), [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):
        w = base[:]
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(120)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    sets = sets_of(rows)
    want = brute_components(sets)
    n_links = {i: sum(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in sets if j != i) for i in sets}
    before = shingle_join.BLOCK, shingle_join.SMALL
    try:
        shingle_join.BLOCK, shingle_join.SMALL = 1500, 100
        got = shingle_join.shingle_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        shingle_join.BLOCK, shingle_join.SMALL = before
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_links for r in got} == n_links


def test_large_groups_stay_whole():
    """A shingle beyond the pair limit joins in a row all that could be linked."""
    n, p = np.sort(np.random.default_rng(2).integers(50, 90, 40)), np.zeros(40, dtype=np.int64)
    exact = {(i, j) for a, b in shingle_join.group_pairs(np.array([0]), np.array([40]), n, p) for i, j in zip(a.tolist(), b.tolist())}
    before = shingle_join.LARGE
    try:
        shingle_join.LARGE = 35
        a, b = next(iter(shingle_join.group_pairs(np.array([0]), np.array([40]), n, p)))
    finally:
        shingle_join.LARGE = before
    label = shingle_join.joined_labels(a, b, 40)
    assert exact and all(label[i] == label[j] for i, j in exact)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)]
    label = {}
    for _ in range(500):
        for a, b in edges:
            label[a] = label[b] = min(label.get(a, a), label.get(b, b))
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: c for i, c in label.items() if any(x != y and i in (x, y) for x, y in edges)}


# fingerprints


def test_phrases():
    text = "abababababcabcabc"
    parse = phrase_print.Parse().feed(text)
    starts = [0, *parse.cuts]
    assert [text[a:b] for a, b in zip(starts, parse.cuts)][:4] == ["a", "b", "ab", "aba"]
    split = phrase_print.Parse().feed(text[:7]).copy().feed(text[7:])
    assert split.cuts == parse.cuts


def test_phrase_prints(docs, local, none):
    rows = phrase_print.phrase_prints(docs).collect()
    assert len(rows) == len(local)
    order = sorted(i for i, _ in local if i is not None)
    texts = {i: text_of(t) for i, t in local}
    for r in rows:
        if r.doc_id is None or r.doc_id in (4, 5) or order[-1] == r.doc_id:
            continue
        text, after = texts[r.doc_id], texts[r.doc_id + 1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other = (phrase_print.fingerprint(x, phrase_print.Parse().feed(x).cuts) for x in (text, edited))
        assert (r.fingerprint, r.edited_fingerprint) == (phrase_print.as_text(own), phrase_print.as_text(other))
        assert r.near_edited == phrase_print.likeness(own, other)
    last = next(r for r in rows if r.doc_id == order[-1])
    text, first = texts[order[-1]], texts[None]
    q = len(text) // 4
    assert last.edited_sha256 == hashlib.sha256((text[: len(text) - q] + first[:q]).encode()).hexdigest()
    assert phrase_print.phrase_prints(none).collect() == []


def test_likeness_tells_edited_from_other(spark):
    rows = phrase_print.phrase_prints(spark.read.parquet(f"{SF}/documents.parquet")).where("n_chars > 200").collect()
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.3


# secrets


def test_secrets(docs, local, none):
    got = {r.doc_id: r for r in secret_scan.secret_spans(docs).collect()}
    for i, t in local:
        found = []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text_of(t), re.I | re.A):
            found += [(m.start(), "assign", m.end())] * (len(m[2]) >= 6)
        base = ",".join(f"{k}:{a}:{b}" for a, k, b in found)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[i].n_assign == len(found)
        assert all(x in got[i].spans.split(",") for x in base.split(",") if x)
    linked = next(r for r in got.values() if r.n_linked)
    assert "ident:" in linked.spans and "endpoint:" in linked.spans
    assert secret_scan.secret_spans(none).collect() == []


def test_weak_parts_need_company(spark):
    value = "Zx9kQ2mN7pL4vB8tR3wY"
    texts = [f"see {value} here", f"user: alice {value}", "at https://api.example.com/v1 only", f"user: alice {'. ' * 200} {value}", "AKIA" + "B" * 16 + f" {value}", "token: abc secret: token: abcdefgh"]
    rows = secret_scan.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_linked for r in rows] == [0, 2, 0, 0, 1, 0] and rows[4].n_access == 1
    assert rows[5].n_assign == 0


def test_parts_are_linked_by_their_gap(spark):
    url = "https://api.example.com/v1?user=alice&token=abcd1234efgh"
    long = "https://api.example.com/" + "a" * 250 + " user: alice token: abcd1234efgh"
    far = "user: alice" + "!" * 201 + "token: abcd1234efgh"
    texts = [url, long, far, far.replace("!!", "!", 1)]
    rows = secret_scan.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0].spans == "endpoint:0:56,ident:27:37,assign:38:56"
    assert [r.n_linked for r in rows] == [2, 2, 0, 1]


# packing


def test_packing(docs, local, none):
    rows = packing.packed_sequences(docs).collect()
    total = Counter()
    bins = defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.n_tokens
        bins[r.bin_id].append(r)
    want = Counter()
    for i, t in local:
        want[i] += len(text_of(t).encode().split())
    assert +total == +want and len({r.doc_id for r in rows}) == len({i for i, _ in local})
    for own in bins.values():
        own.sort(key=lambda r: (r.bin_offset, r.n_tokens))
        assert all(a.bin_offset + a.n_tokens == b.bin_offset for a, b in zip(own, own[1:]))
        used = own[-1].bin_offset + own[-1].n_tokens
        assert {r.bin_length for r in own} == {min(c for c in packing.LENGTHS if c >= used)}
    assert packing.packed_sequences(none).collect() == []


def test_packing_is_tight():
    rng = random.Random(2)
    pieces = sorted((min(4096, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(5000)), reverse=True)
    _, _, opened = packing.pack(pieces)
    assert sum(pieces) / sum(opened) > 0.97


# mixture


def test_rake_meets_targets():
    rng = np.random.default_rng(0)
    margins = [rng.integers(0, k, 400) for k in (6, 3, 4)]
    tokens = rng.integers(1, 1000, 400).astype(float)
    targets = [rng.dirichlet(np.ones(k) * 5) for k in (6, 3, 4)]
    weight, error = mixture.rake(tokens, margins, targets)
    assert error < 1e-6
    for of, target in zip(margins, targets):
        assert np.allclose(np.bincount(of, tokens * weight, len(target)) / tokens.sum(), target, atol=1e-6)
    full = lambda f: f * weight >= 1
    f = mixture.sampling_factor(lambda f: (tokens[full(f)].sum(), (tokens * weight)[~full(f)].sum()), tokens.sum(), 0.6)
    assert math.isclose((tokens * np.minimum(1, f * weight)).sum(), 0.6 * tokens.sum(), rel_tol=1e-9)


def test_mixture(docs, none, local):
    rows = mixture.mixture(docs).collect()
    assert len(rows) == len(local)
    assert all(r.mix_n_tokens == len(text_of(r.row.text).encode().split()) for r in rows)
    total = sum(r.mix_n_tokens for r in rows)
    assert abs(sum(r.mix_n_tokens * r.mix_probability for r in rows) - mixture.SHARE * total) < 1e-6 * total
    picked = mixture.sampled(docs)
    assert picked.columns == docs.columns and picked.count() == sum(r.mix_sampled for r in rows)
    assert mixture.sampled(none).collect() == []


# language model


def test_model_is_a_distribution():
    rng = random.Random(4)
    texts = [[bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    codes = np.concatenate([ppm.grams_of(list(ppm.segments(t)))[0] for t in texts])
    orders = []
    for j in range(ppm.ORDER + 1):
        code, n = np.unique(codes & ((1 << 8 * (j + 1)) - 1), return_counts=True)
        context, of = np.unique(code >> 8, return_inverse=True)
        total = np.bincount(of, n).astype(np.int64)
        keep = total >= 4  # contexts and symbols are left out, as at scale
        rare = keep[of] & (n >= 2)
        orders.append((code[rare], n[rare], context[keep], total[keep]))
    trie = ppm.Trie(orders)
    for start in (0, 0xFFFFFFFFFF, *(int(c) >> 8 for c in rng.sample(codes.tolist(), 20))):
        every = trie.log10((np.int64(start) << 8) | np.arange(256))
        assert math.isclose(float((10.0**every).sum()), 1, rel_tol=1e-9)


def test_corpus_scores(docs, local, none):
    got = {r.doc_id: r for r in ppm.corpus_scores(docs).collect()}
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    tally = Counter()
    for i, t in local:
        if crc(i) % 5 != 1:
            tally.update([*text_of(t).encode().lower().split(), "end"])
    n, v = sum(tally.values()), len(tally)
    for i, t in local:
        tokens = [*text_of(t).encode().lower().split(), "end"]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 5 == 1, len(tokens), sum(tally[x] > 0 for x in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((tally[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens), rel_tol=1e-9)
        assert r.score < 0
    assert ppm.corpus_scores(none).collect() == []


def test_scores_are_of_all_contexts(spark):
    """Contexts that occur once in a corpus of over 2^18 bytes count, as in a plain count of everything."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    local = [(i, " ".join(rng.choice(vocabulary) for _ in range(300))) for i in range(200)]
    got = {r.doc_id: r for r in ppm.corpus_scores(spark.createDataFrame(local, "doc_id long, text string").repartition(4)).collect()}
    event = lambda t: b"\xff" * ppm.ORDER + t.encode() + b"\xff"
    counts = defaultdict(Counter)
    for i, t in local:
        if not got[i].held_out:
            e = event(t)
            for at in range(ppm.ORDER, len(e)):
                for j in range(ppm.ORDER + 1):
                    counts[e[at - j : at]][e[at]] += 1
    assert sum(counts[b""].values()) > 1 << 18
    tried = [i for i, _ in local if got[i].held_out][:3] + [i for i, _ in local if not got[i].held_out][:3]
    for i in tried:
        e, score = event(local[i][1]), 0.0
        for at in range(ppm.ORDER, len(e)):
            excluded = set()
            for j in range(ppm.ORDER, -1, -1):
                seen = counts.get(e[at - j : at])
                if not seen:
                    continue
                left = {x: n for x, n in seen.items() if x not in excluded}
                mass = sum(left.values())
                if e[at] in left:
                    score += math.log10((left[e[at]] - 0.5) / mass)
                    break
                if mass:
                    score += math.log10(len(left) / 2 / mass)
                excluded |= set(seen)
            else:
                score -= math.log10(256 - len(excluded))
        assert math.isclose(got[i].score, score, rel_tol=1e-6)


def test_scores_with_more_buckets_and_parts(spark, docs, none, monkeypatch):
    """Buckets that follow the corpus, and contexts whose requests are dealt into parts, change no score."""
    dealt = docs.repartition(6)
    usual = sorted((r.doc_id is None, r.doc_id, r.score, r.base_score) for r in ppm.corpus_scores(dealt).collect())
    assert ppm.bucket_bits(0) == ppm.bucket_bits(30 << 30) == ppm.BUCKET and ppm.bucket_bits(10 << 40) == 19 and ppm.bucket_bits(1 << 60) == ppm.NEAR
    monkeypatch.setattr(ppm, "BUCKET_BYTES", 16)
    tables = []
    monkeypatch.setattr(ppm, "written", lambda df, what: (tables.append(what), common.written(df, what))[1])
    assert ppm.bucket_bits(60_000) > ppm.BUCKET
    for grams, fan in ((40, 2), (7, 16)):
        monkeypatch.setattr(ppm, "TASK_GRAMS", grams)
        monkeypatch.setattr(ppm, "FAN", fan)
        got = sorted((r.doc_id is None, r.doc_id, r.score, r.base_score) for r in ppm.corpus_scores(dealt).collect())
        assert [r[:2] for r in got] == [r[:2] for r in usual]
        assert np.allclose([r[2:] for r in got], [r[2:] for r in usual], rtol=1e-6)
    assert tables.count("sums") > 2
    assert ppm.corpus_scores(none).collect() == []


def test_long_texts_are_scored_in_pieces(monkeypatch):
    words = [b"abc", b"de"] * 400
    whole = ppm.grams_of(list(ppm.segments(words)))[0]
    monkeypatch.setattr(ppm, "CHUNK", 64)
    assert np.array_equal(ppm.grams_of(list(ppm.segments(words)))[0], whole)


# quality


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{os.path.dirname(SF)}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    held = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert np.mean([s.predicted == q for s, q in held]) > 0.95 and len(rows) == docs.count()
    good = [s.score for s, q in held if q]
    bad = [s.score for s, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_quality_of_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(none, labels).collect() == []
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns


# all of them


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(spark, name):
    from tests.oracle import same

    same(llm.queries()[name](spark, SF), llm.oracle_sql()[name])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    own = spark.conf.get(common.ARROW_KEY)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, before = docs.columns, {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == columns and {r.doc_id for r in docs.collect()} <= before
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert spark.conf.get(common.ARROW_KEY) == own  # the quality stage's bound has gone with it
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.n_tokens
    assert all(got[i] == len(texts[i].encode().split()) for i in got)
    kept = [texts[i] for i in got]
    assert len(set(kept)) == len(kept)
    labels = brute_components(sets_of(list(zip(got, kept))))
    assert all(i == c for i, c in labels.items())
