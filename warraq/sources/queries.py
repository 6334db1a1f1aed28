"""Queries of the sources, sinks, ledgers and mirrors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warraq.operators.analytics import JOBS, jobs
from warraq.registry import query
from warraq.sources import corpus as C
from warraq.sources import sinks as S
from warraq.sources.folders import fresh_folder


@query("src_corpus_tables", "SELECT passage_id AS main_id, edition_id AS book_id, unit_num, concat(part, '/', page) AS part_page, lag(passage_id) OVER w AS prev_id, lead(passage_id) OVER w AS next_id FROM passages WINDOW w AS (PARTITION BY edition_id ORDER BY passage_id)")
def _(t):
    """The passages written as a source table, and read back by the reader."""
    order = Window.partitionBy("edition_id").orderBy("passage_id")
    rows = t.passages.select(
        F.col("edition_id").alias("book_id"), F.col("passage_id").alias("main_id"), F.lit(None).cast("string").alias("html"), F.col("text_raw").alias("text_plain"), F.col("unit_num").alias(C.UNIT_NUMBER),
        F.concat_ws("/", "part", "page").alias("part_page"), F.lag("passage_id").over(order).alias("prev_id"), F.lead("passage_id").over(order).alias("next_id"),
    )
    path = fresh_folder(t.spark, "source")
    rows.write.parquet(f"{path}/matn.parquet")
    return C.read_source(t.spark, "units", "matn", path=path).select("main_id", "book_id", F.col(C.UNIT_NUMBER).alias("unit_num"), "part_page", "prev_id", "next_id")


@query("src_archive_pages", "SELECT row_number() OVER (ORDER BY page_id % 7, url)::BIGINT - 1 AS seq, 'page' AS kind, html AS text_raw, html, url AS slug, regexp_extract(url, 'com/([a-z]+)/', 1) AS section FROM pages")
def _(t):
    pages = t.pages.select(F.col("url").alias("slug"), "url", F.regexp_extract("url", "com/([a-z]+)/", 1).alias("section"), (F.col("page_id") % 7).alias("ord"), F.lit("t").alias("title"), F.col("html").alias("text"), "html", "page_id")
    return C.archive_passages(pages, 1, ("page_id",)).select("seq", "kind", "text_raw", "html", F.get_json_object("meta", "$.slug").alias("slug"), F.get_json_object("meta", "$.section").alias("section"))


@query("src_broken_csv", "SELECT CAST(doc_id AS VARCHAR) AS id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS segments FROM documents")
def _(t):
    """The documents written as broken records, a line each, and read back by the reader."""
    quoted = F.concat(F.lit('"'), F.replace(F.translate("text", "\n", "\r"), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = t.documents.select(F.concat_ws(",", F.col("doc_id") % 9, "doc_id", quoted, F.lit("1"), F.lit("2")).alias("value"))
    path = fresh_folder(t.spark, "broken")
    lines.unionByName(t.spark.createDataFrame([("hno,id,nass,page,part",)], "value string")).write.text(path)
    return C.read_broken_csv(t.spark, path).select("id", F.size("segments").cast("long").alias("segments"))


@query("sink_csv_roundtrip", "SELECT count(*) AS n_rows, 0 AS lost, 0 AS made FROM documents")
def _(t):
    path, rows = fresh_folder(t.spark, "csv"), t.documents.select("doc_id", "lang", "text")
    C.write_csv(rows, path)
    back = C.read_csv(t.spark, path, rows.schema)
    both = rows.withColumn("n", F.lit(1)).unionByName(back.withColumn("n", F.lit(-1)))
    left = both.groupBy(*rows.columns).agg(F.sum("n").alias("n"))  # how many more of a row were written than read
    sides = left.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).cast("int").alias("lost"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).cast("int").alias("made"))
    return rows.agg(F.count("*").alias("n_rows")).crossJoin(sides)


@query("sink_jsonl_split", "SELECT CASE WHEN m < 90 THEN 'train' WHEN m < 95 THEN 'dev' ELSE 'test' END AS split, count(*) AS n FROM (SELECT ((('0x' || substr(md5(doc_id::VARCHAR), 1, 16))::UBIGINT % 100) * 16 + ('0x' || substr(md5(doc_id::VARCHAR), 17, 16))::UBIGINT % 100) % 100 AS m FROM documents) GROUP BY 1")
def _(t):
    from warraq.functions.text import hash_split
    rows = t.documents.select("text", hash_split(F.col("doc_id").cast("string")).alias("split"))
    return C.write_jsonl_split(rows, fresh_folder(t.spark, "jsonl"))


@query("sink_replace_by_edition", "SELECT edition_id, count(*) * CASE WHEN edition_id < 10 THEN 1 ELSE 1 END AS n, max(CASE WHEN edition_id < 10 THEN 'new' ELSE 'old' END) AS version FROM passages GROUP BY 1")
def _(t):
    path = fresh_folder(t.spark, "passages")
    rows = t.passages.select("passage_id", "edition_id")
    S.replace_by_edition(rows.withColumn("version", F.lit("old")), path)
    S.replace_by_edition(rows.where("edition_id < 10").withColumn("version", F.lit("new")), path)
    return t.spark.read.parquet(path).groupBy("edition_id").agg(F.count("*").alias("n"), F.max("version").alias("version"))


def halves(t):
    old = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    new = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("v"))
    return old, new


@query("sink_upsert", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS v FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0")
def _(t):
    return S.upsert(*halves(t), ["k"])


@query("sink_insert_if_absent", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN 'old' ELSE 'new' END AS v FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0")
def _(t):
    return S.insert_if_absent(*halves(t), ["k"])


@query("sink_upsert_guarded", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN 'manual' WHEN c_custkey % 2 = 0 THEN 'rule' ELSE 'text' END AS source FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0")
def _(t):
    old, new = halves(t)
    old = old.select("k", F.when(F.col("k") % 5 == 0, "manual").otherwise("text").alias("source"))
    return S.upsert_guarded(old, new.select("k", F.lit("rule").alias("source")), ["k"], ["book-convention", "manual"])


@query("ledger_skip_done", f"WITH j AS ({JOBS}) SELECT passage_id FROM passages WHERE passage_id NOT IN (SELECT passage_id FROM j WHERE status = 'done')")
def _(t):
    return S.not_done(t.passages.select("passage_id"), jobs(t), ["passage_id"])


@query("ledger_skip_unchanged", f"WITH j AS ({JOBS}) SELECT p.passage_id FROM passages p LEFT JOIN j USING (passage_id) WHERE j.content_hash IS DISTINCT FROM substr(sha256(text_raw), 1, 16)")
def _(t):
    from warraq.functions.text import content_hash

    return S.changed(t.passages.select("passage_id", content_hash(F.col("text_raw")).alias("content_hash")), jobs(t), ["passage_id"]).select("passage_id")


@query("ledger_progress", f"WITH j AS ({JOBS}) SELECT status, count(*) AS n, max(passage_id) AS last FROM j GROUP BY 1")
def _(t):
    return jobs(t).groupBy("status").agg(F.count("*").alias("n"), F.max("passage_id").alias("last"))


@query("ledger_last_steps", f"WITH j AS ({JOBS}) SELECT passage_id, status FROM j ORDER BY passage_id DESC LIMIT 5")
def _(t):
    return jobs(t).orderBy(F.desc("passage_id")).limit(5).select("passage_id", "status")


STAGED = "SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'other' ELSE 'units' END AS source, (o_custkey % 30)::INT AS source_book_id, o_orderkey AS seq, concat('layer', o_orderkey % 3) AS layer FROM orders"
MAPPED = f"SELECT p.passage_id, s.* FROM ({STAGED}) s JOIN editions e ON e.source = s.source AND e.source_book_id = s.source_book_id JOIN passages p ON p.edition_id = e.edition_id AND p.seq = s.seq"


def staged_layers(t) -> DataFrame:
    source = F.when(F.col("o_orderkey") % 9 == 0, "other").otherwise("units")
    return t.orders.select(source.alias("source"), (F.col("o_custkey") % 30).cast("int").alias("source_book_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("layer"), F.col("o_orderkey") % 3).alias("layer"))


@query("sync_by_natural_key", MAPPED)
def _(t):
    return S.mapped_by_natural_key(staged_layers(t), t.editions, t.passages)


@query("sync_skipped", f"SELECT *, staged - mapped AS skipped FROM (SELECT (SELECT count(*) FROM ({STAGED})) AS staged, (SELECT count(*) FROM ({MAPPED})) AS mapped)")
def _(t):
    staged = staged_layers(t)
    return S.mapping_counts(staged, S.mapped_by_natural_key(staged, t.editions, t.passages))


@query("sync_mirror", "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'insert' WHEN c_custkey % 2 <> 0 THEN 'delete' ELSE 'update' END AS action, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0 GROUP BY 1")
def _(t):
    return S.mirror_actions(*halves(t), ["k"], "v").groupBy("action").agg(F.count("*").alias("n"))


@query("sync_table_counts", "SELECT 'customer' AS name, (SELECT count(*) FROM customer) AS source, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS target UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders)")
def _(t):
    from warraq.operators.analytics import totals

    row = lambda name, a, b: totals(source=a, target=b).select(F.lit(name).alias("name"), "source", "target")
    return row("customer", t.customer, t.customer.where("c_custkey % 2 = 0")).unionByName(row("orders", t.orders, t.orders))
