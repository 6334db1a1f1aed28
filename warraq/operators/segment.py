"""Ordered scans of an edition: TOC trees, page anchors and numbered units."""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warraq.bindings import MARKS
from warraq.functions.arabic import normalize_arabic
from warraq.operators.ordering import in_ranges, numbered
from warraq.operators.rules import NUMBER_HEAD, classified, heading_level, heading_level_of, line_starts, lines_of, may_head, reconciled, synthetic_pages
from warraq.functions.vectorized import once, vectorized
from warraq.registry import query
from warraq.sources.folders import fresh_folder, written


def heading_lines(pages: DataFrame) -> DataFrame:
    """The heading lines of pages, with kind and title."""
    lines = classified(lines_of(pages, keep=may_head).drop("text_raw"))
    return lines.select("*", "head.kind", "head.title").drop("head").where("kind is not null and title <> ''")


def toc_nodes(pages: DataFrame) -> DataFrame:
    """Nodes (edition_id, ord, passage_id, kind, title, parent_ord, depth) of the headings of
    (passage_id, edition_id, seq, text_raw), in reading order.

    What is open is the last node of a kind since the last of a wider kind: windows, no loop."""
    heads = heading_lines(pages).select("edition_id", "seq", "passage_id", "line_no", "kind", F.left("title", F.lit(200)).alias("title"))
    reading = Window.partitionBy("edition_id").orderBy("seq", "line_no")  # one exchange and one sort for both steps
    nodes = heads.withColumn("ord", F.row_number().over(reading))
    before = reading.rowsBetween(Window.unboundedPreceding, -1)
    of = lambda k: F.last(F.when(F.col("kind") == k, F.col("ord")), ignorenulls=True).over(before)
    nodes = nodes.withColumns({"one": of(1), "two": of(2)})
    nodes = nodes.withColumn("two", F.when(F.coalesce("two", F.lit(0)) > F.coalesce("one", F.lit(0)), F.col("two")))
    kind = F.col("kind")
    return nodes.select(
        "edition_id", "ord", "passage_id", "kind", "title",
        F.when(kind == 2, F.col("one")).when(kind == 3, F.coalesce("two", "one")).alias("parent_ord"),
        F.when(kind == 1, 1).when(kind == 2, F.when(F.col("one").isNotNull(), 2).otherwise(1)).otherwise(F.when(F.coalesce("two", "one").isNull(), 1).when(F.col("one").isNotNull() & F.col("two").isNull(), 2).otherwise(3)).alias("depth"),
    )


def anchor_pages(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each page with the first node opened on it, else the innermost one open before."""
    first = nodes.groupBy("passage_id").agg(F.min("ord").alias("first"))
    last = nodes.groupBy("passage_id").agg(F.max_by(F.struct("ord", "kind"), "ord").alias("last"))
    ends = nodes.groupBy("passage_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("ord"))).alias(f"k{k}") for k in (1, 2, 3)))
    rows = pages.select("edition_id", "seq", "passage_id").join(first, "passage_id", "left").join(ends, "passage_id", "left")
    before = Window.partitionBy("edition_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"o{k}": F.last(f"k{k}", ignorenulls=True).over(before) for k in (1, 2, 3)})
    one, two, three = (F.coalesce(f"o{k}", F.lit(0)) for k in (1, 2, 3))
    two = F.when(two > one, two).otherwise(0)
    three = F.when((three > one) & (three > two), three).otherwise(0)
    inner = F.when(three > 0, three).when(two > 0, two).when(one > 0, one)
    return rows.select("passage_id", F.coalesce("first", inner).alias("node_ord"))


def nested_toc(entries: DataFrame) -> DataFrame:
    """The parent of each (edition_id, ord, level): the nearest earlier entry of a smaller level."""
    before = Window.partitionBy("edition_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.last(F.when(F.col("level") < k, F.col("ord")), ignorenulls=True).over(before) for k in (2, 3, 4)]
    parent = F.when(F.col("level") == 2, above[0]).when(F.col("level") == 3, above[1]).when(F.col("level") == 4, above[2])
    return entries.withColumn("parent_ord", parent)


# A number that opens a unit, with the number in the whole work, and one that may repeat it.
NUMBER = r"^\s*([0-9٠-٩]+)\s*[-–—]\s*(?:\(\s*([0-9٠-٩]+)\s*\))?"
REPEAT = r"^\s*\(\s*([0-9٠-٩]+)\s*\)\s*\S"
NEAR = 20
UNIT = "edition_id int, unit_seq int, unit_num string, start_passage_id long, start_off int, end_passage_id long, end_off int, local_num string, repeat boolean"


def number_in(line: F.Column, pattern: str, group: int) -> F.Column:
    digits = F.translate(F.regexp_extract(line, pattern, group), "٠١٢٣٤٥٦٧٨٩", "0123456789")
    return F.try_to_number(F.when(F.length(digits).between(1, 18), digits), F.lit("9" * 18)).cast("long")


def streamed(scan, schema: str):
    """``scan`` (a generator function of all rows, as tuples) over a task's batches: it holds only what it keeps itself."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        held = []
        for out in scan(rows):
            held.append(out)
            if len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), types)], schema=types)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), types)], schema=types)

    return run


def _units(rows):
    """Units of parts, from their lines in order; a part begins with a line whose number holds whatever was
    before it, so parts need nothing of each other."""
    part = opened = last = None
    for edition, of, at, passage, local, whole, again, start, heading, page_end, final in rows:
        if (edition, of) != part:
            part, opened, last = (edition, of), None, None
        number, repeat = (local if whole is None else whole), False
        if number is None and again is not None and last is not None and abs(again - last) <= NEAR:
            number, repeat = again, True
        if opened and (number is not None or heading or final):
            yield (edition, *opened[:4], passage, page_end if final else start, *opened[4:])
            opened = None
        if number is not None:
            last = number
            opened = (at, str(number), passage, start, str(local) if whole is not None else None, repeat)


PART = "edition_id int, at long, unit_num string, start_passage_id long, start_off int, end_passage_id long, end_off int, local_num string, repeat boolean"


def segment_units_pages(pages: DataFrame) -> DataFrame:
    """Units across the pages of an edition.

    Only lines that can open or close a unit count, as numbers and places without their text, and a
    row for the end of each edition's last page.  A number of its own sets the state whatever it was,
    so a scan in ranges numbers the parts that begin with one, a part is also told where the next
    begins, and tasks resolve parts: an edition with a third of all lines lies in very many."""
    able = lambda line: line.rlike(r"^\s*[0-9٠-٩]+\s*[-–—]|^\s*\(\s*[0-9٠-٩]+\s*\)\s*\S")
    lines = lines_of(pages.select("edition_id", "seq", "passage_id", "text_raw"), keep=lambda line: able(line) | may_head(line))
    kept = once(classified(lines.drop("text_raw")), able=able(F.col("line")), heading=F.col("head").isNotNull()).where("able or heading")
    none = F.lit(None).cast("long")
    marks = kept.select("edition_id", "seq", "line_no", "passage_id", number_in(F.col("line"), NUMBER, 1).alias("local"), number_in(F.col("line"), NUMBER, 2).alias("whole"), number_in(F.col("line"), REPEAT, 1).alias("again"), "start", "heading", F.lit(0).alias("page_end"), F.lit(False).alias("final"))
    last = pages.groupBy("edition_id").agg(F.max(F.struct("seq", "passage_id", F.length("text_raw").alias("page_end"))).alias("x"))
    ends = last.select("edition_id", "x.seq", F.lit(2**31 - 1).alias("line_no"), "x.passage_id", none.alias("local"), none.alias("whole"), none.alias("again"), F.lit(0).alias("start"), F.lit(False).alias("heading"), "x.page_end", F.lit(True).alias("final"))
    # written before it is numbered: dealing by ranges looks at what it deals twice
    rows = written(marks.unionByName(ends), "marks").withColumn("opens", F.coalesce("whole", "local").isNotNull().cast("long"))
    placed = numbered(rows, ["edition_id"], ["seq", "line_no"], ["opens"], "at")
    part = F.col("opens_so_far")
    columns = ["at", "passage_id", "local", "whole", "again", "start", "heading", "page_end", "final"]
    own = placed.where(part > 0).select("edition_id", part.alias("part"), *columns)
    # the line that begins a part closes the one before
    closing = {"local": none, "whole": none, "again": none, "heading": F.lit(True)}
    before = placed.where((F.col("opens") == 1) & (part > 1)).withColumns(closing).select("edition_id", (part - 1).alias("part"), *columns)
    rows = own.unionByName(before).repartition("edition_id", "part").sortWithinPartitions("edition_id", "part", "at")
    units = numbered(written(rows.mapInArrow(streamed(_units, PART), PART), "units"), ["edition_id"], ["at"], position="unit_seq")
    return units.select("edition_id", F.col("unit_seq").cast("int").alias("unit_seq"), *(c.split()[0] for c in UNIT.split(", ")[2:]))


OPENER = r"^(حدثنا|حدثني|اخبرنا|اخبرني|انبانا|سمعت|عن|قال\s+رسول|وحدثنا|وحدثني|واخبرنا|واخبرني)(\s|$)"
#: How a line begins, in front of its first letter, that may be a heading or open a chain: only these are normalised.
MAY_OPEN = rf"(?U)^[\s{MARKS}]*[كاأإآٱبفمحسعقو]"
#: So many letters that normalisation keeps, in front of anything else.
LONG = rf"(?U)^(?:[\s{MARKS}]*+[^\s{MARKS}]){{20}}"


@vectorized("array<int>")
def numbers_kept(numbers):
    """Each list with 0 in the place of numbers that the others don't fit; 0 is no number."""

    def kept(x):
        at = [i for i, n in enumerate(x) if n]
        stay = {at[i] for i in reconciled([int(x[i]) for i in at])}
        return [int(n) if i in stay else 0 for i, n in enumerate(x)]

    return numbers.map(lambda x: kept(x) if x is not None else None)


def segment_units_flat(pages: DataFrame) -> DataFrame:
    """Units (passage_id, start, end, number, heading) of flat pages: boundaries are headings, number
    heads and lines that open a chain; a unit runs to the next boundary.

    Of a page's numbers only those of a roughly rising run open units (years and page numbers break
    it), and such a unit starts at its number.  A page is a row of its own: its boundaries are an array, in
    as many steps as it has lines, and nothing is shuffled."""
    each = lambda of, c: F.transform(c, of)
    rows = once(pages.select("passage_id", "text_raw"), lines=F.split("text_raw", "\n"))
    rows = once(rows, starts=line_starts(each(lambda x: F.length(x) + 1, "lines")), digits=each(lambda x: F.regexp_extract(x, NUMBER_HEAD, 1), "lines"), norms=each(lambda x: F.when(x.rlike(MAY_OPEN), normalize_arabic(x)), "lines"))
    number = lambda d: F.when(d != "", F.translate(d, "٠١٢٣٤٥٦٧٨٩", "0123456789").cast("int"))
    rows = once(rows, numbers=each(number, "digits"), levels=each(heading_level_of, "norms"), opens=each(lambda n: n.rlike(OPENER), "norms"))
    zipped = F.transform("lines", lambda x, i: F.struct(
        F.get("starts", i).alias("start"), x.alias("line"), F.get("levels", i).alias("level"), F.coalesce(F.get("numbers", i), F.lit(0)).alias("number"), F.coalesce(F.get("opens", i), F.lit(False)).alias("opens")))
    bounds = lambda m: m["level"].isNotNull() | (m["number"] > 0) | m["opens"]
    rows = once(rows, marks=F.filter(zipped, bounds)).select("passage_id", "text_raw", "marks").where(F.size("marks") > 0)
    # two numbers are a run of their own
    many = F.size(F.filter("marks", lambda m: m["number"] > 0)) >= 3
    rows = rows.withColumn("kept", numbers_kept(F.when(many, each(lambda m: m["number"], "marks"))))
    digit = lambda m: F.regexp_instr(m["line"], F.lit("[0-9٠-٩]")) - 1
    left = lambda m, i: F.when(F.col("kept").isNull(), m["number"]).otherwise(F.get("kept", i))
    marks = F.transform("marks", lambda m, i: F.struct(m["start"].alias("start"), m["line"].alias("line"), m["level"].alias("level"), left(m, i).alias("number"), m["opens"].alias("opens")))
    marks = F.transform(F.filter(marks, bounds), lambda m: F.struct(F.when(m["number"] > 0, m["start"] + digit(m)).otherwise(m["start"]).alias("start"), m["level"].alias("level"), F.when(m["number"] > 0, m["number"]).alias("number"), F.when(m["level"].isNotNull(), F.trim(m["line"])).alias("title")))
    rows = once(rows, marks2=marks).drop("marks", "kept")
    rows = once(rows, heads=F.filter(F.transform("marks2", lambda m, i: F.when(m["level"].isNotNull(), i)), lambda i: i.isNotNull()))
    # a heading stands for all marks up to the next one
    spans = F.transform("heads", lambda p, j: F.array_repeat(p, F.coalesce(F.get("heads", j + 1), F.size("marks2")) - p))
    none = F.array_repeat(F.lit(None).cast("int"), F.coalesce(F.get("heads", F.lit(0)), F.size("marks2")))
    rows = once(rows, under=F.concat(none, F.flatten(spans)), size=F.length("text_raw"))
    listed = F.transform("marks2", lambda m, i: F.struct(
        m["start"].alias("start"), F.coalesce(F.get("marks2", i + 1)["start"], F.col("size")).alias("end"), m["number"].alias("number"), F.get("marks2", F.get("under", i))["title"].alias("heading"), m["level"].alias("level")))
    units = rows.select("passage_id", "text_raw", F.inline(F.filter(listed, lambda m: m["level"].isNull())))
    units = once(units, unit=F.trim(F.substring("text_raw", F.col("start") + 1, F.col("end") - F.col("start"))))
    return units.where(F.when(F.col("unit").rlike(LONG), True).otherwise(F.length(normalize_arabic(F.col("unit"))) >= 20)).select("passage_id", "start", "end", "number", "heading", "unit")


def sanad_end_from_spans(units: DataFrame, annotations: DataFrame) -> DataFrame:
    """The first MATN span after a unit's start with an ISNAD span before it, within the unit."""
    rows = units.join(annotations.select(F.col("passage_id").alias("start_passage_id"), "spans"), "start_passage_id")
    limit = F.when(F.col("start_passage_id") == F.col("end_passage_id"), F.col("end_off"))
    inside = F.filter("spans", lambda s: (s["end"] > F.col("start_off")) & (limit.isNull() | (s["start"] < limit)))
    isnad = F.array_min(F.transform(F.filter(inside, lambda s: s["label"] == "ISNAD"), lambda s: s["start"]))
    matn = F.array_min(F.transform(F.filter(inside, lambda s: (s["label"] == "MATN") & (s["start"] > F.col("start_off")) & (s["start"] > isnad)), lambda s: s["start"]))
    return rows.select("edition_id", "unit_seq", matn.alias("sanad_end_off"))


ACCEPTED = "edition_id int, seq long, number int, until int, accepted boolean"
#: Heads of a block.
BLOCK = 1 << 16
BLOCKED = "edition_id int, block long, at long, seq long, numbers array<int>, opens boolean, before binary, after binary"


def run_of(numbers: list[int] | None) -> tuple[int, int] | None:
    """First and last of numbers that follow each other."""
    if numbers and numbers[0] > 0 and numbers == list(range(numbers[0], numbers[0] + len(numbers))):
        return numbers[0], numbers[-1]
    return None


def summed_up(heads) -> dict[int, int]:
    """The last accepted number after a block of heads (numbers, opens), by that before it; a number that
    is not in the result stays as it is.  From the last head to the first: a head that continues
    ``x`` leads on to what the heads after it make of its own last number."""
    after: dict[int, int] = {}
    for numbers, opens in reversed(heads):
        run = run_of(numbers)
        if run and (run[0] > 1 or opens):
            after[run[0] - 1] = after.get(run[1], run[1])
    return after


def _blocked(most: int):
    """Heads with the block that they are in, and a row for each block with what it does to the last number."""

    def run(rows):
        task, k, held, own = TaskContext.get().partitionId() << 32, 0, [], None

        def closed():
            found = sorted(summed_up([(numbers, opens) for _, numbers, opens in held]).items())
            packed = [np.array(x, dtype=np.int64).tobytes() for x in zip(*found)] or [b"", b""]
            return (own, task + k, None, None, None, None, *packed)

        for edition, seq, numbers, opens in rows:
            if held and (edition != own or len(held) == most):
                yield closed()
                held, k = [], k + 1
            own = edition
            held.append((seq, numbers, bool(opens)))
            yield (edition, task + k, len(held), seq, numbers, bool(opens), None, None)
        if held:
            yield closed()

    return run


def _entered(rows):
    """For each block, in order, the number that was accepted last before it."""
    edition, last = object(), 0
    for of, block, before, after in rows:
        if of != edition:
            edition, last = of, 0
        yield block, last
        keys = np.frombuffer(before, np.int64)
        at = int(np.searchsorted(keys, last))
        if at < len(keys) and keys[at] == last:
            last = int(np.frombuffer(after, np.int64)[at])


def _accepted(rows):
    """Heads of blocks, each behind the row with the number that was accepted last before it."""
    last = 0
    for edition, at, seq, numbers, opens, entered in rows:
        if at == 0:
            last = entered
            continue
        run = run_of(numbers)
        good = run is not None and run[0] == last + 1 and bool(last > 0 or opens)
        last = run[1] if good else last
        yield (edition, seq, numbers[0] if numbers else None, numbers[-1] if numbers else None, good)


def accept_sequence(heads: DataFrame, block: int = BLOCK) -> DataFrame:
    """Heads (edition_id, seq, numbers, opens): numbers, one or a run of several, are accepted only in turn,
    the first only where a chain opens it.

    A scan in blocks: heads are dealt by ranges of (edition, seq); each block is summed up as a function
    of the number accepted before it; one row a block is enough to know what enters each block, by
    a binary search a block; then blocks are resolved, each in a task of its own."""
    spark = heads.sparkSession
    rows = heads.select(F.col("edition_id").cast("int").alias("edition_id"), F.col("seq").cast("long").alias("seq"), F.col("numbers").cast("array<int>").alias("numbers"), F.col("opens").cast("boolean").alias("opens"))
    dealt = in_ranges(rows, ["edition_id", "seq"])
    path = fresh_folder(spark, "blocks")
    dealt.mapInArrow(streamed(_blocked(block), BLOCKED), BLOCKED).write.parquet(path)
    blocks = spark.read.schema(BLOCKED).parquet(path)
    sums = blocks.where("before is not null").select("edition_id", "block", "before", "after")
    entered = sums.repartition("edition_id").sortWithinPartitions("edition_id", "block").mapInArrow(streamed(_entered, "block long, entered long"), "block long, entered long")
    first = entered.select("block", F.lit(None).cast("int").alias("edition_id"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("array<int>").alias("numbers"), F.lit(None).cast("boolean").alias("opens"), "entered")
    own = blocks.where("before is null").select("block", "edition_id", "at", "seq", "numbers", "opens", F.lit(None).cast("long").alias("entered"))
    rows = own.unionByName(first).repartition("block").sortWithinPartitions("block", "at").drop("block")
    return rows.mapInArrow(streamed(_accepted, ACCEPTED), ACCEPTED)


def missing_numbers(accepted: DataFrame, known: DataFrame) -> DataFrame:
    """The numbers (edition_id, number) from 1 to the largest of ``known`` (edition_id, number) that no accepted head (number, until) has."""
    wanted = known.groupBy("edition_id").agg(F.max("number").alias("n")).select("edition_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number"))
    has = accepted.where("accepted").select("edition_id", F.explode(F.sequence("number", "until")).alias("number")).distinct()
    return wanted.join(has, ["edition_id", "number"], "left_anti")


def spans_of_units(units: DataFrame) -> DataFrame:
    """A stand-in annotation of each start page: a chain span and a text span after it."""
    span = lambda a, b, label: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(label).alias("label"))
    s = F.col("start_off")
    return units.groupBy(F.col("start_passage_id").alias("passage_id")).agg(F.array_sort(F.flatten(F.collect_list(F.array(span(s + 2, s + 20, "ISNAD"), span(s + 21, s + 60, "MATN"))))).alias("spans"))


HEADS = "SELECT edition_id, passage_id, seq, CASE WHEN passage_id % 7 = 0 THEN 1 WHEN passage_id % 3 = 0 THEN 2 WHEN passage_id % 11 = 0 THEN 3 END AS kind FROM passages"
NODES = f"WITH h AS (SELECT *, row_number() OVER (PARTITION BY edition_id ORDER BY seq)::INT AS ord FROM ({HEADS}) WHERE kind IS NOT NULL), o AS (SELECT *, max(CASE WHEN kind = 1 THEN ord END) OVER w AS one, max(CASE WHEN kind = 2 THEN ord END) OVER w AS two0 FROM h WINDOW w AS (PARTITION BY edition_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), n AS (SELECT *, CASE WHEN coalesce(two0, 0) > coalesce(one, 0) THEN two0 END AS two FROM o)"


@query("build_toc_tree", NODES + " SELECT edition_id, ord, passage_id, kind, CASE kind WHEN 2 THEN one WHEN 3 THEN coalesce(two, one) END AS parent_ord, CASE WHEN kind = 1 THEN 1 WHEN kind = 2 THEN CASE WHEN one IS NULL THEN 1 ELSE 2 END WHEN coalesce(two, one) IS NULL THEN 1 WHEN two IS NULL THEN 2 ELSE 3 END AS depth FROM n")
def _(t):
    return toc_nodes(synthetic_pages(t)).drop("title")


@query("anchor_pages", f"""WITH k AS (SELECT *, CASE WHEN kind IS NOT NULL THEN sum(CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY edition_id ORDER BY seq) END AS ord FROM ({HEADS})),
  o AS (SELECT *, {", ".join(f"coalesce(max(CASE WHEN kind = {k} THEN ord END) OVER w, 0) AS o{k}" for k in (1, 2, 3))} FROM k WINDOW w AS (PARTITION BY edition_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  p AS (SELECT *, CASE WHEN o2 > o1 THEN o2 ELSE 0 END AS p2 FROM o), q AS (SELECT *, CASE WHEN o3 > o1 AND o3 > p2 THEN o3 ELSE 0 END AS p3 FROM p)
  SELECT passage_id, coalesce(ord, CASE WHEN p3 > 0 THEN p3 WHEN p2 > 0 THEN p2 WHEN o1 > 0 THEN o1 END)::INT AS node_ord FROM q""")
def _(t):
    pages = synthetic_pages(t)
    return anchor_pages(pages, toc_nodes(pages))


@query("nested_toc", "WITH h AS (SELECT edition_id, seq, CASE WHEN passage_id % 7 = 0 THEN 1 WHEN passage_id % 3 = 0 THEN 3 END AS level FROM passages), o AS (SELECT *, row_number() OVER (PARTITION BY edition_id ORDER BY seq)::INT AS ord FROM h WHERE level IS NOT NULL) SELECT edition_id, ord, level, CASE WHEN level = 3 THEN max(CASE WHEN level = 1 THEN ord END) OVER (PARTITION BY edition_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_ord FROM o")
def _(t):
    heads = lines_of(synthetic_pages(t)).select("edition_id", "seq", "line_no", heading_level(F.col("line")).alias("level")).where("level is not null")
    return nested_toc(heads.select("edition_id", F.row_number().over(Window.partitionBy("edition_id").orderBy("seq", "line_no")).alias("ord"), "level"))


@query("segment_units_pages", "SELECT edition_id, row_number() OVER (PARTITION BY edition_id ORDER BY seq)::INT AS unit_seq, CAST(passage_id % 3000 + 1 AS VARCHAR) AS unit_num, passage_id AS start_passage_id FROM passages")
def _(t):
    units = segment_units_pages(synthetic_pages(t))
    return units.where(~F.coalesce("repeat", F.lit(False))).select("edition_id", F.row_number().over(Window.partitionBy("edition_id").orderBy("unit_seq")).alias("unit_seq"), "unit_num", "start_passage_id")


@query("segment_units_flat", """WITH h AS (SELECT passage_id, CASE WHEN passage_id % 7 = 0 THEN concat('كتاب الرقم ', passage_id % 5) WHEN passage_id % 3 = 0 THEN concat('باب في ', passage_id % 11) WHEN passage_id % 11 = 0 THEN '[فصل في البيان]' END AS head,
    concat(passage_id % 3000 + 1, ' - ', text_raw, CASE WHEN passage_id % 5 = 0 THEN concat(chr(10), '(3) حاشية') ELSE '' END) AS body FROM passages)
  SELECT passage_id, coalesce(length(head) + 1, 0)::INT AS start, (coalesce(length(head) + 1, 0) + length(body))::INT AS "end", (passage_id % 3000 + 1)::INT AS number, CASE WHEN passage_id % 7 = 0 OR passage_id % 3 = 0 THEN head END AS heading FROM h""")
def _(t):
    return segment_units_flat(synthetic_pages(t, t.unkept("passages"))).select("passage_id", "start", "end", "number", "heading")


@query("sanad_end_from_spans")
def _(t):
    units = segment_units_pages(synthetic_pages(t))
    return sanad_end_from_spans(units, spans_of_units(units))


@query("accept_sequence")
def _(t):
    """Heads of one number, and of a run of two where the page says so."""
    k = (F.col("passage_id") % 40 + 1).cast("int")
    heads = t.passages.select("edition_id", "seq", F.when(F.col("passage_id") % 3 == 0, F.array(k, k + 1)).otherwise(F.array(k)).alias("numbers"), F.col("text_norm").rlike("^(حدثنا|حدثني|اخبرنا)").alias("opens"))
    return accept_sequence(heads)


@query("missing_numbers", "WITH k AS (SELECT edition_id, (passage_id % 3000 + 1)::INT AS number FROM passages) SELECT e.edition_id, n.n::INT AS number FROM (SELECT edition_id, max(number) AS m FROM k GROUP BY 1) e, generate_series(1, m) n(n) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.edition_id = e.edition_id AND k.number = n.n)")
def _(t):
    number = (F.col("passage_id") % 3000 + 1).cast("int")
    rows = t.passages.select("edition_id", number.alias("number"), number.alias("until"), F.lit(True).alias("accepted"))
    return missing_numbers(rows, rows.select("edition_id", "number"))
