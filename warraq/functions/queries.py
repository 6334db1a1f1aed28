"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from warraq.bindings import MARKS, UNIFIED
from warraq.functions import arabic as A
from warraq.functions import marks as M
from warraq.functions import text as X
from warraq.registry import query

FOLD = f"trim(regexp_replace(translate(regexp_replace(text_raw, '[{MARKS}]', '', 'g'), '{UNIFIED[0]}', '{UNIFIED[1]}'), '\\s+', ' ', 'g'))"


@query("normalize_arabic", f"SELECT passage_id, {FOLD} AS text_norm FROM passages")
def _(t):
    return t.passages.select("passage_id", A.normalize_arabic(F.col("text_raw")).alias("text_norm"))


@query("fold_letters", f"SELECT passage_id, translate(regexp_replace(text_raw, '[{A.CLASSIFIER_MARKS}]', '', 'g'), '{A.CLASSIFIER_FOLD[0]}', '{A.CLASSIFIER_FOLD[1]}') AS folded FROM passages")
def _(t):
    return t.passages.select("passage_id", A.fold_letters(F.col("text_raw")).alias("folded"))


@query("fold_heading", f"SELECT work_id, translate(regexp_replace(title_ar, '[{A.CLASSIFIER_MARKS}]', '', 'g'), '{A.HEADING_FOLD[0]}', '{A.HEADING_FOLD[1]}') AS folded FROM works")
def _(t):
    return t.works.select("work_id", A.fold_heading(F.col("title_ar")).alias("folded"))


@query("has_tashkeel", f"SELECT passage_id, regexp_matches(text_raw, '[{A.VOWELS}]') AS marked, regexp_replace(text_raw, '[{A.VOWELS}]', '', 'g') AS bare FROM passages")
def strip_tashkeel(t):
    return t.passages.select("passage_id", A.has_tashkeel(F.col("text_raw")).alias("marked"), A.strip_tashkeel(F.col("text_raw")).alias("bare"))


@query("strip_tashkeel", f"SELECT passage_id, regexp_replace(text_raw, '[{A.VOWELS}]', '', 'g') AS bare FROM passages")
def _(t):
    return t.passages.select("passage_id", A.strip_tashkeel(F.col("text_raw")).alias("bare"))


@query(
    "vocal_density",
    f"""SELECT passage_id, round(len(regexp_extract_all(text_raw, '[{A.VOWELS}]')) / nullif(len(regexp_extract_all(text_raw, '[ء-غف-ي]')), 0), 6) AS density FROM passages""",
)
def _(t):
    return t.passages.select("passage_id", F.round(A.vocal_density(F.col("text_raw")), 6).alias("density"))


@query("strip_html")
def _(t):
    return t.pages.select("page_id", X.strip_html(F.col("html"), scripts=True).alias("text"))


@query("strip_junk", "SELECT count(*) AS n_rows, count_if(contains(junk, 'AddHistory(')) AS before, count_if(contains(trim(regexp_replace(junk, 'AddHistory\\([^)]*\\)[^;]*;?', '', 'g')), 'AddHistory(')) AS after, sum(length(trim(regexp_replace(junk, 'AddHistory\\([^)]*\\)[^;]*;?', '', 'g'))))::BIGINT AS chars FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN concat('AddHistory(', doc_id, ');', text) ELSE text END AS junk FROM documents)")
def _(t):
    junk = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("AddHistory("), F.col("doc_id"), F.lit(");"), F.col("text"))).otherwise(F.col("text"))
    rows = t.documents.select(junk.alias("junk")).withColumn("clean", X.strip_junk(F.col("junk")))
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(X.has_junk(F.col("junk"))).alias("before"), F.count_if(X.has_junk(F.col("clean"))).alias("after"), F.sum(F.length("clean")).alias("chars"))


@query("clean_display", "SELECT passage_id, trim(regexp_replace(text_raw, '§', '', 'g')) AS shown FROM passages")
def _(t):
    dirty = F.concat(F.when(F.col("passage_id") % 2 == 0, "AddHistory(1); [3/4] ").otherwise("ب - "), F.col("text_raw"), F.lit(" §"))
    return t.passages.select("passage_id", X.clean_display(dirty).alias("shown"))


@query("fix_newlines", "SELECT count_if(contains(replace(text, chr(10), chr(13)), chr(13))) AS affected, sum(length(text))::BIGINT AS chars, count_if(replace(replace(text, chr(10), chr(13)), chr(13), chr(10)) = text) AS restored FROM documents")
def _(t):
    rows = t.documents.select("text", F.translate("text", "\n", "\r").alias("raw"))
    fixed = X.fix_newlines(F.col("raw"))
    return rows.agg(F.count_if(F.col("raw").contains("\r")).alias("affected"), F.sum(F.length(fixed)).alias("chars"), F.count_if(fixed == F.col("text")).alias("restored"))


@query("split_part_page", "SELECT passage_id, CASE WHEN passage_id % 4 <> 0 THEN part END AS part, page FROM passages")
def _(t):
    joined = F.when(F.col("passage_id") % 4 != 0, F.concat_ws("/", "part", "page")).otherwise(F.col("page"))
    part, page = X.part_and_page(F.col("joined"))
    return t.passages.select("passage_id", joined.alias("joined")).select("passage_id", part.alias("part"), page.alias("page"))


@query("digits_to_latin", "SELECT passage_id, CAST(passage_id % 3000 AS VARCHAR) AS num FROM passages")
def _(t):
    eastern = F.translate(F.concat(F.lit("00"), (F.col("passage_id") % 3000).cast("string")), A.DIGITS[1], A.DIGITS[0])
    return t.passages.select("passage_id", A.digits_to_latin(eastern).alias("num"))


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def _(t):
    return t.documents.select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query("hash_split", "SELECT doc_id, CASE WHEN m < 90 THEN 'train' WHEN m < 95 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, ((('0x' || substr(md5(doc_id::VARCHAR), 1, 16))::UBIGINT % 100) * 16 + ('0x' || substr(md5(doc_id::VARCHAR), 17, 16))::UBIGINT % 100) % 100 AS m FROM documents)")
def _(t):
    return t.documents.select("doc_id", X.hash_split(F.col("doc_id").cast("string")).alias("split"))


@query("chunk_text")
def _(t):
    return t.documents.select("doc_id", F.posexplode(X.chunk_text(F.col("text"))).alias("chunk_no", "chunk")).withColumn("hash", X.content_hash(F.col("chunk")))


@query("word_windows")
def _(t):
    return t.documents.select("doc_id", F.posexplode(X.word_windows(F.col("text"))).alias("window_no", "window"))


@query("ws_tokenize", "SELECT passage_id, len(string_split_regex(text_norm, ' +')) AS n, sum(length(w))::BIGINT AS chars FROM (SELECT passage_id, text_norm, unnest(string_split_regex(text_norm, ' +')) AS w FROM passages) GROUP BY passage_id, text_norm")
def _(t):
    tokens = t.passages.select("passage_id", F.inline(X.ws_tokenize(F.col("text_norm"))))
    return tokens.groupBy("passage_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query("norm_with_map", "SELECT passage_id, text_norm AS norm, length(text_norm) AS n FROM passages")
def _(t):
    return t.passages.select("passage_id", M.norm_with_map(F.col("text_raw")).alias("x")).select("passage_id", "x.norm", F.size("x.at").cast("long").alias("n"))


BARE = "regexp_replace(text_raw, '[ً-ْٰ]', '', 'g')"


@query("split_marks", f"SELECT passage_id, {BARE} AS bare, length({BARE}) AS letters, len(regexp_extract_all(text_raw, '[^ً-ْٰ][ً-ْٰ]+')) AS marked FROM passages")
def _(t):
    rows = t.passages.select("passage_id", M.split_marks(F.col("text_raw")).alias("x"))
    return rows.select("passage_id", "x.bare", F.size("x.classes").cast("long").alias("letters"), F.size(F.filter("x.classes", lambda k: k > 0)).cast("long").alias("marked"))


@query("apply_marks", f"SELECT passage_id, regexp_replace({BARE}, '(.)', '\\1َ', 'g') AS marked FROM passages")
def _(t):
    """Every letter of the bare text with the first mark."""
    bare = A.strip_tashkeel(F.col("text_raw"))
    return t.passages.select("passage_id", M.apply_marks(bare, F.array_repeat(F.lit(1), F.length(bare))).alias("marked"))


@query("transplant_marks", f"""SELECT passage_id, regexp_replace(regexp_replace({BARE}, '([ء-ي])', '\\1َ', 'g'), '^', '§ ') AS marked FROM passages""")
def _(t):
    """The marks of a page whose every letter has one, and whose letters differ in form, onto bare text with signs between."""
    bare = A.strip_tashkeel(F.col("text_raw"))
    page = F.regexp_replace(F.translate(bare, "اة", "أه"), "([ء-ي])", "$1َ")
    return t.passages.select("passage_id", M.transplant_marks(F.concat(F.lit("§ "), bare), F.concat(F.lit("12، "), page)).alias("marked"))


@query("merge_bare_words", "SELECT passage_id, regexp_replace(regexp_replace(text_raw, '(^| )نافع( |$)', '\\1نَافِع\\2', 'g'), '(^| )مالك( |$)', '\\1مَالِك\\2', 'g') AS merged FROM passages")
def _(t):
    forms = F.create_map(F.lit("نافع"), F.lit("نَافِع"), F.lit("مالك"), F.lit("مَالِك"))
    return t.passages.select("passage_id", M.merge_bare_words(F.col("text_raw"), forms).alias("merged"))


@query("map_offset", f"SELECT passage_id, CAST(length(text_raw) - length(regexp_replace(text_raw, '[{A.VOWELS}]', '', 'g')) AS BIGINT) AS shift FROM passages")
def _(t):
    bare = A.strip_tashkeel(F.col("text_raw"))
    end = M.map_offset(bare, F.col("text_raw"), F.length(bare))
    return t.passages.select("passage_id", (end - F.length(bare)).cast("long").alias("shift"))


@query("token_overlap", "SELECT a.item_id AS a_id, b.item_id AS b_id, round(len(list_intersect(list_distinct(string_split(a.text, ' ')), list_distinct(string_split(b.text, ' '))))::DOUBLE / least(len(list_distinct(string_split(a.text, ' '))), len(list_distinct(string_split(b.text, ' ')))), 4) AS overlap FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def _(t):
    a = t.benchmark.select(F.col("item_id").alias("a_id"), F.split("text", " ").alias("x"))
    b = t.benchmark.select(F.col("item_id").alias("b_id"), F.split("text", " ").alias("y"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).select("a_id", "b_id", F.round(X.token_overlap(F.col("x"), F.col("y")), 4).alias("overlap"))


@query("ordered_token_hit", "SELECT a_id, round(coalesce(len(list_filter(x, lambda w: list_contains(y, w)))::DOUBLE / nullif(len(x), 0), 0), 4) AS hit FROM (SELECT a.item_id AS a_id, list_filter(string_split(a.text, ' '), lambda w: length(w) >= 3)[1:25] AS x, string_split(b.text, ' ') AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)")
def _(t):
    a = t.benchmark.select(F.col("item_id").alias("a_id"), F.split("text", " ").alias("x"))
    b = t.benchmark.select(F.col("item_id").alias("b_id"), F.split("text", " ").alias("y"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).select("a_id", F.round(X.ordered_token_hit(F.col("x"), F.col("y")), 4).alias("hit"))


SPANS = "array<struct<start:int,end:int,label:string>>"


@query("json_project", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, concat('p', event_id % 3) AS place, 2::INT AS places, CAST(event_id % 50 + 1 AS INT) AS first_end FROM events""")
def _(t):
    """A scalar key, an array and spans of a JSON column."""
    k = F.col("event_id")
    meta = F.to_json(F.struct(F.array(F.concat(F.lit("p"), k % 3), F.lit("q")).alias("places"), F.array(F.struct(F.lit(0).alias("start"), (k % 50 + 1).alias("end"), F.lit("A").alias("label"))).alias("spans")))
    rows = t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.from_json(meta, f"places array<string>, spans {SPANS}").alias("m"))
    return rows.select("event_id", "k", F.col("m.places")[0].alias("place"), F.size("m.places").alias("places"), F.col("m.spans")[0]["end"].alias("first_end"))


@query("cost_estimate", "SELECT source, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / 2.5 / 1000000 * 0.15, 6) AS usd FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.sum(F.length("text")).alias("chars")).withColumn("usd", X.embedding_cost(F.col("chars")))


@query("snippet_highlight", """WITH p AS (SELECT passage_id, string_split(text_norm, ' ') AS w FROM passages), x AS (SELECT passage_id, i, w[i * 40 + 1:i * 40 + 40] AS part FROM p, range(0, 1000) r(i) WHERE i * 40 < len(w)),
  y AS (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY len(list_filter(part, lambda v: v IN ('رسول', 'مالك'))) DESC, i) AS rn FROM x WHERE len(list_filter(part, lambda v: v IN ('رسول', 'مالك'))) > 0)
  SELECT passage_id, string_agg(array_to_string(list_transform(part, lambda v: CASE WHEN v IN ('رسول', 'مالك') THEN concat('<mark>', v, '</mark>') ELSE v END), ' '), ' … ' ORDER BY i) AS snippet FROM y WHERE rn <= 2 GROUP BY 1""")
def _(t):
    rows = t.passages.select("passage_id", X.snippet_highlight(F.split("text_norm", " "), ["رسول", "مالك"]).alias("snippet"))
    return rows.where("snippet <> ''")


@query("preview", "SELECT doc_id, left(text, 220) AS preview FROM documents")
def _(t):
    return t.documents.select("doc_id", X.preview(F.col("text")).alias("preview"))
