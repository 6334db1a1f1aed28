"""Keyword search over positional postings: a table by term that a search reads only its own terms of.

A posting is a row (term, passage_id, place, n): the place of the term in the text, and the length
of the text beside it.  The table is dealt by ranges of (term, passage_id) and sorted by (term,
passage_id, place), so a frequent term lies in many files and a rare one in one page; terms are
coded as runs, ids and places as differences (Parquet's delta encoding), and statistics of files,
row groups and pages tell a filter on terms what it can leave out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.sources.folders import fresh_folder

#: Bytes of a row group, and rows of a page: what a search leaves out at least.
GROUP_BYTES, PAGE_ROWS = 16 << 20, 4096


def text_postings(passages: DataFrame, text: str = "text_norm", path: str | None = None) -> DataFrame:
    """The postings of ``passages`` (passage_id, text), written to ``path`` (or a new folder) and read from there.

    Words are what single spaces part; empty ones have a place and count in the length, but no
    posting.  A text that is null has none."""
    spark = passages.sparkSession
    path = path or fresh_folder(spark, "postings")
    words = passages.select("passage_id", F.split(text, " ").alias("w"))
    rows = words.select("passage_id", F.size("w").alias("n"), F.posexplode("w").alias("place", "term")).where("term <> ''")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("term", "passage_id", "place", "n").repartitionByRange(parts, "term", "passage_id").sortWithinPartitions("term", "passage_id", "place")
    writer = dealt.write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
    writer.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def matched(postings: DataFrame, groups: list[list[list[str]]], excluded: list[list[str]]) -> DataFrame:
    """Passages (passage_id, n, hits) that have every phrase of one of ``groups`` and none of ``excluded``;
    hits: how many of their words are words of the groups.

    A phrase of k words begins where k postings agree on the place of its first word; so phrases are
    counts of (passage, phrase, beginning), with partial sums, whatever words they repeat."""
    phrases = dict.fromkeys(tuple(p) for p in [*(p for g in groups for p in g), *excluded])
    numbers = {p: i for i, p in enumerate(phrases)}
    wanted = {w for g in groups for p in g for w in p}
    roles: dict[str, list[tuple[int, int]]] = {}
    for p, i in numbers.items():
        for offset, w in enumerate(p):
            roles.setdefault(w, []).append((i, offset))
    role = lambda i, offset: F.struct(F.lit(i).alias("phrase"), F.lit(offset).alias("offset"))
    own, hit = None, -1  # the role of a hit is no phrase
    for w, of in roles.items():
        listed = F.array(*(role(i, o) for i, o in of), *([role(hit, 0)] if w in wanted else []))
        own = F.when(F.col("term") == w, listed) if own is None else own.when(F.col("term") == w, listed)
    rows = postings.where(F.col("term").isin(*roles)).select("passage_id", "n", "place", F.inline(own))
    begins = F.when(F.col("phrase") != hit, F.col("place") - F.col("offset"))
    counted = rows.groupBy("passage_id", "n", "phrase", begins.alias("begins")).agg(F.count("*").alias("k"))
    length = F.element_at(F.array(*(F.lit(len(p)) for p in numbers)), F.col("phrase") + 1)
    there = F.when((F.col("phrase") != hit) & (F.col("k") == F.when(F.col("phrase") != hit, length)), F.col("phrase"))
    hits = F.coalesce(F.sum(F.when(F.col("phrase") == hit, F.col("k"))), F.lit(0))
    found = counted.groupBy("passage_id", "n").agg(F.collect_set(there).alias("has"), hits.alias("hits"))
    every = lambda g: F.array_size(F.array_except(F.array(*(F.lit(numbers[tuple(p)]) for p in g)), "has")) == 0
    holds = F.lit(False)
    for g in groups:
        holds = holds | every(g)
    for p in excluded:
        holds = holds & ~F.array_contains("has", numbers[tuple(p)])
    return found.where(holds).select("passage_id", "n", "hits")


def fts_match(table: DataFrame, search: str, n: int | None = 50) -> DataFrame:
    """The ``n`` best passages (None: all, in no order) that match a search line (see ``parse_search``), by
    score and id.  The score is the hits of the wanted words over 1 + log of the length.

    ``table``: postings, or passages (passage_id, text_norm), whose postings are then written first."""
    from warraq.operators.search import parse_search

    postings = table if "term" in table.columns else text_postings(table)
    groups, excluded = parse_search(search)
    if not groups:
        return postings.where("false").select("passage_id", F.lit(0.0).alias("score"))
    score = F.round(F.col("hits") / (1 + F.log(F.col("n").cast("double"))), 5)
    found = matched(postings, groups, excluded).select("passage_id", score.alias("score"))
    return found if n is None else found.orderBy(F.desc("score"), "passage_id").limit(n)


def rows_read(df: DataFrame) -> int:
    """Rows that the scans of ``df``, a frame without exchanges, hand on when it is run."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
