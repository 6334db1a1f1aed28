"""Scans in ranges and blocks against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from warraq.operators import rules, segment
from warraq.operators.ordering import numbered


@pytest.fixture
def parts(spark):
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield 7
    spark.conf.set("spark.sql.shuffle.partitions", own)


@pytest.mark.parametrize("keys", [["k"], []])
def test_places_and_sums_in_any_order(spark, parts, keys):
    """A group with most of the rows, one that is null, null orders and values."""
    rng = random.Random(1)
    rows = [(rng.choice(["a"] * 5 + ["b", "c", None]), rng.randrange(50) if rng.random() < 0.9 else None, rng.choice([1, 2, None]), i) for i in range(2000)]
    got = numbered(spark.createDataFrame(rows, "k string, o int, v long, i long").repartition(5), keys, ["o", "i"], ["v"]).collect()
    groups, want = defaultdict(list), {}
    for row in rows:
        groups[row[0] if keys else 0].append(row)
    for group in groups.values():
        total = 0
        for place, row in enumerate(sorted(group, key=lambda r: (r[1] is not None, r[1] or 0, r[3]))):
            total += row[2] or 0
            want[row[3]] = (place + 1, total)
    assert {r.i: (r.pos, r.v_so_far) for r in got} == want and len(got) == len(rows)
    assert numbered(spark.createDataFrame([], "k string, o int"), ["k"], ["o"]).collect() == []


def sequence_by_hand(heads):
    out, last = set(), defaultdict(int)
    for e, seq, numbers, opens in sorted(heads, key=lambda h: (h[0] is not None, h[0] or 0, h[1])):
        good = bool(numbers) and numbers[0] == last[e] + 1 and numbers == list(range(numbers[0], numbers[-1] + 1)) and (last[e] > 0 or bool(opens))
        if good:
            last[e] = numbers[-1]
        out.add((e, seq, numbers[0] if numbers else None, numbers[-1] if numbers else None, good))
    return out


@pytest.mark.parametrize("block", [1 << 16, 5, 1])
def test_sequences_in_blocks(spark, parts, block):
    rng, heads = random.Random(block), []
    for e in [1, 1, 1, 2, None]:  # the first has most of the heads
        for k in range(300):
            at = 1 + k // 5  # a number comes several times, so that one that is missed comes again
            first = rng.choice([at, at, at, rng.randrange(-1, 40)])
            numbers = rng.choice([[first], [first], [first, first + 1], [first, first + 2], [], None])
            heads.append((e, len(heads), numbers, rng.choice([True, True, False, None])))
    got = segment.accept_sequence(spark.createDataFrame(heads, "edition_id int, seq long, numbers array<int>, opens boolean").repartition(3), block)
    assert {tuple(r) for r in got.collect()} == sequence_by_hand(heads)
    assert got.where("accepted").count() > 20 and got.count() == len(heads)


def test_a_block_is_a_function_of_the_number_before_it():
    rng = random.Random(8)
    for _ in range(200):
        heads = [([n, n + 1] if rng.random() < 0.2 else [n], rng.random() < 0.5) for n in rng.choices(range(1, 9), k=rng.randrange(12))]
        after = segment.summed_up(heads)
        for x in range(10):
            last = x
            for numbers, opens in heads:
                if numbers[0] == last + 1 and (last > 0 or opens):
                    last = numbers[-1]
            assert after.get(x, x) == last


def units_by_hand(pages):
    out = []
    by = defaultdict(list)
    for passage, e, seq, text in sorted(pages, key=lambda p: (p[1], p[2])):
        by[e].append((passage, text))
    for e, listed in by.items():
        opened, last, n = None, None, 0
        for passage, text in listed:
            at = 0
            for line in text.split("\n"):
                number = repeat = local = None
                if line[0].isdigit():
                    own, _, rest = line.partition(" - ")
                    number, local = (int(rest[1 : rest.index(")")]), own) if rest.startswith("(") else (int(own), None)
                elif line.startswith("(") and last is not None and abs(int(line[1 : line.index(")")]) - last) <= 20:
                    number, repeat = int(line[1 : line.index(")")]), True
                if opened and (number is not None or line.startswith("باب")):
                    n += 1
                    out.append((e, n, *opened[:3], passage, at, *opened[3:]))
                    opened = None
                if number is not None:
                    last, opened = number, (str(number), passage, at, local, bool(repeat))
                at += len(line) + 1
        if opened:
            out.append((e, n + 1, *opened[:3], listed[-1][0], len(listed[-1][1]), *opened[3:]))
    return sorted(out, key=repr)


def test_units_of_a_large_edition_in_parts(spark, parts):
    rng, pages = random.Random(6), []
    for e in [1, 1, 1, 2, 3]:
        for _ in range(30):
            lines = []
            for _ in range(rng.randrange(1, 5)):
                k = rng.randrange(1, 90)
                lines.append(rng.choice([f"{k} - نص", f"{k} - ({k + 7}) نص", f"({k}) نص آخر", f"({k}) نص آخر", "باب جديد في كذا", "سطر عادي"]))
            pages.append((len(pages), e, len(pages), "\n".join(lines)))
    got = segment.segment_units_pages(spark.createDataFrame(pages, "passage_id long, edition_id int, seq int, text_raw string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == units_by_hand(pages)


def test_lines_and_their_starts(spark, monkeypatch):
    monkeypatch.setattr(rules, "LINE_CHUNK", 4)
    rng = random.Random(2)
    texts = ["", "\n", "a", None, *("\n".join("x" * rng.randrange(4) + "é" * rng.randrange(2) for _ in range(k)) for k in (3, 4, 5, 8, 9, 40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = {(i, n, line, len("\n".join(t.split("\n")[:n])) + bool(n)) for i, t in enumerate(texts) if t is not None for n, line in enumerate(t.split("\n"))}
    assert {(r.i, r.line_no, r.line, r.start) for r in rules.lines_of(rows, "t").collect()} == want
    some = rules.lines_of(rows, "t", keep=lambda x: F.length(x) > 2)
    assert {(r.i, r.line_no, r.line, r.start) for r in some.collect()} == {w for w in want if len(w[2]) > 2}
