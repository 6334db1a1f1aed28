"""Readers of the source tables and repairs of what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.functions.arabic import normalize_arabic
from warraq.operators.ordering import numbered

#: Fixed value: how the source calls the number of a unit.
UNIT_NUMBER = "unit_num"
#: Columns of the source tables by source and table.
SOURCES = {
    "units": {"books": "id, name, ord, book_type, section_id, section_name", "toc": "book_id, node_id, parent_id, title, is_leaf, ord", "matn": "book_id, main_id, html, text_plain, unit_num, part_page, prev_id, next_id", "subjects": "node_id, parent_id, title, is_leaf, ord", "subject_hits": "subject_id, book_id, main_id, ord"},
    "pages": {"books": "archive, bkid, name, auth, category, pages_expected, pages_loaded", "pages": "bkid, page_id, part, page, hno, sora, aya, nass"},
}


def read_source(spark: SparkSession, source: str, table: str, *, path: str | None = None, jdbc: dict | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A source table from a Parquet export, or over JDBC in ranges (column, lower, upper, parts)."""
    columns = [c.strip() for c in SOURCES[source][table].split(",")]
    if path:
        return spark.read.parquet(f"{path}/{table}.parquet").select(*columns)
    reader = spark.read.format("jdbc").options(**jdbc, dbtable=table)
    if partition:
        column, lower, upper, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load().select(*columns)


def archive_passages(pages: DataFrame, edition: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Archive pages (slug, url, section, ord, title, text, html) as passages, numbered from 0 in (ord,
    slug) order over the whole edition, by a scan in ranges of that order.  Pages that are alike in both
    come by ``ties``, the columns that tell them apart, and not as files happen to be read."""
    columns = ["slug", "url", "section", "ord", "title", "text", "html"]
    rows = numbered(pages.select(*columns, *ties), [], ["ord", "slug", *ties], position="place")
    place = F.col("place") - 1
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        F.lit(edition).alias("edition_id"), place.alias("source_page_id"), place.alias("seq"), F.lit("page").alias("kind"),
        text.alias("text_raw"), normalize_arabic(text).alias("text_norm"), "html", F.to_json(F.struct("slug", "url", "section", "title")).alias("meta"),
    )


RECORD = r"(?s)^([^,]*),([^,]*),(.*),([^,]*),([^,]*)\r?$"


def repaired_csv(lines: DataFrame) -> DataFrame:
    """Records (hno, id, segments, page, part) of raw lines (value) whose long field may hold commas,
    bare carriage returns and doubled quotes."""
    part = lambda k: F.regexp_extract("value", RECORD, k)
    long = part(3)
    inner = F.when(long.rlike(r'(?s)^".*"$'), F.replace(F.substring(long, F.lit(2), F.length(long) - 2), F.lit('""'), F.lit('"'))).otherwise(long)
    segments = F.filter(F.transform(F.split(inner, "\r"), lambda s: F.trim(s)), lambda s: s != "")
    return lines.where(F.col("value").rlike(RECORD) & (F.trim("value") != "")).select(part(1).alias("hno"), part(2).alias("id"), segments.alias("segments"), part(4).alias("page"), part(5).alias("part"))


def read_broken_csv(spark: SparkSession, path: str) -> DataFrame:
    """The file at ``path`` without its header, repaired."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return repaired_csv(lines.where(~F.col("value").startswith("hno,")))


#: What no text holds (characters that Unicode keeps out of interchange): an unquoted empty field is read as this, and so as null.
NO_TEXT = "\ufdd0\uffff"


def write_csv(df: DataFrame, path: str) -> None:
    """RFC-4180 files with a header: blanks at the ends of a text are its own, an empty text is quoted, a null one is not."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue=NO_TEXT if len(df.columns) == 1 else "", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True, nullValue=NO_TEXT, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_jsonl_split(df: DataFrame, path: str) -> DataFrame:
    """JSON lines by split, and the number of each."""
    df.write.mode("overwrite").partitionBy("split").json(path)
    return df.groupBy("split").agg(F.count("*").alias("n"))
