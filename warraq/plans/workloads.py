"""The three main workloads, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from warraq.operators import chains, joins, rules, segment
from warraq.registry import query


@query("workload_knowledge_graph")
def _(t):
    """Units to chains to narrators to edges to the heaviest pairs."""
    built = chains.graph_from_texts(t.passages, t.narrators)
    return built.orderBy(F.desc("weight"), "student", "teacher").limit(50)


@query("workload_timeline", f"SELECT basis, year_best, count(*) AS n, round(avg(confidence), 4) AS confidence FROM ({rules.DATED_SQL}) GROUP BY 1, 2")
def _(t):
    """Units typed, dated and counted by basis and year: types and dates share one scan and one shuffle."""
    return rules.dated_units(t).groupBy("basis", "year_best").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


@query("workload_page_archive")
def _(t):
    """Pages to TOC and units, and units to the other edition of their work."""
    pages = rules.synthetic_pages(t)
    units = segment.segment_units_pages(pages)
    texts = pages.select(F.col("passage_id").alias("start_passage_id"), "text_raw")
    placed = units.join(texts, "start_passage_id").join(t.editions.select("edition_id", "work_id"), "edition_id")
    from warraq.functions.arabic import normalize_arabic

    text = normalize_arabic(F.substring(F.col("text_raw"), F.col("start_off") + 1, F.lit(800)))
    rows = placed.select(F.col("start_passage_id").alias("passage_id"), "edition_id", "unit_seq", "work_id", F.col("unit_num").alias("num"), text.alias("text_norm"))
    rows = rows.withColumn("num", (F.col("num").cast("int") % 200).cast("string"))
    a, b = rows.where("edition_id % 2 = 0"), rows.where("edition_id % 2 = 1")
    crossed = joins.crosswalk_units(a, b.select(F.col("passage_id").alias("unit_id"), "unit_seq", "work_id", "num", F.col("text_norm").alias("unit_text")))
    return crossed.agg(F.count("*").alias("matched"), F.round(F.avg("confidence"), 4).alias("confidence"), F.countDistinct("num").alias("numbers"))
