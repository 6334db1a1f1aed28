"""Feature tables for models, label work and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warraq.functions.arabic import normalize_arabic, vocalised_window
from warraq.functions.text import hash_split, strip_junk, word_windows, ws_tokenize
from warraq.registry import query


def labelled_words(text, sanad_end, most: int = 220):
    """array<struct<token, label>>: HNUM for a leading number, ISNAD up to the boundary, MATN after it."""
    tokens = F.slice(ws_tokenize(text), 1, most)
    label = lambda w: F.when((w["idx"] == 0) & w["token"].rlike("^[0-9٠-٩]"), "HNUM").when(w["start"] < sanad_end, "ISNAD").otherwise("MATN")
    return F.transform(tokens, lambda w: F.struct(w["token"].alias("token"), label(w).alias("label")))


def boundary_rows(t) -> DataFrame:
    units = t.passages.join(t.chains.where("ord = 0 and confidence >= 0.3 and sanad_end_raw > 30"), "passage_id")
    return units.select("passage_id", "text_raw", "sanad_end_raw")


LABELLED = """w AS (SELECT passage_id, sanad_end_raw, string_split(text_raw, ' ') AS w FROM passages JOIN chains USING (passage_id) WHERE ord = 0 AND confidence >= 0.3 AND sanad_end_raw > 30),
  l AS (SELECT passage_id, i - 1 AS idx, w[i] AS token, CASE WHEN length(array_to_string(w[1:i - 1], ' ')) + (i > 1)::INT < sanad_end_raw THEN 'ISNAD' ELSE 'MATN' END AS label FROM w, range(1, 221) r(i) WHERE i <= len(w))"""


@query("label_words", f"WITH {LABELLED} SELECT passage_id, idx::INT AS idx, token, label FROM l")
def _(t):
    words = boundary_rows(t).select("passage_id", labelled_words(F.col("text_raw"), F.col("sanad_end_raw")).alias("w"))
    return words.select("passage_id", F.posexplode("w").alias("idx", "x")).select("passage_id", "idx", "x.token", "x.label")


def tashkeel_windows(passages: DataFrame, target: int, preferred: F.Column, letters: int = 60, density: float = 0.6) -> DataFrame:
    """Up to ``target`` well vocalised windows of passages, those of preferred editions first, with their split."""
    windows = passages.select("passage_id", "edition_id", F.posexplode(word_windows(strip_junk(F.col("text_raw")))).alias("n", "text"))
    dense = windows.where(vocalised_window(F.col("text"), letters=letters, density=density))
    return dense.orderBy(F.when(preferred, 0).otherwise(1), "passage_id", "n").limit(target).select("passage_id", "n", "text", hash_split(F.concat_ws(":", "passage_id", "n")).alias("split"))


@query("ds_tashkeel")
def _(t):
    """The passages vocalised by rule (a mark after each letter of every second one), at the thresholds of production."""
    marked = F.when(F.col("passage_id") % 2 == 0, F.regexp_replace("text_raw", "([ء-ي])", "$1َ")).otherwise(F.col("text_raw"))
    return tashkeel_windows(t.passages.withColumn("text_raw", marked), 500, F.col("edition_id") % 2 == 1)


def indexing_rows(passages: DataFrame, chains: DataFrame, toc: DataFrame, least: int = 150, most: int = 4000, target: int | None = None) -> DataFrame:
    """Units with a sure boundary and headings; with a ``target`` as many units at most, in the order of a hash of the id."""
    texts = passages.where(F.length("text_raw").between(least, most)).select("passage_id")
    units = chains.where("ord = 0 and confidence >= 0.9 and sanad_end_raw > 30").join(texts, "passage_id", "left_semi")
    if target is not None:
        units = units.orderBy(F.md5(F.col("passage_id").cast("string")), "passage_id").limit(target)
    heads = toc.where(F.length("title").between(15, 200)).select(F.col("node_id").alias("passage_id"), F.lit("heading").alias("kind"), F.lit(None).cast("int").alias("sanad_end_raw"))
    return units.select("passage_id", F.lit("unit").alias("kind"), "sanad_end_raw").unionByName(heads)


@query("ds_indexing", "(SELECT passage_id, 'unit' AS kind, sanad_end_raw FROM passages JOIN chains USING (passage_id) WHERE ord = 0 AND confidence >= 0.9 AND sanad_end_raw > 30 AND length(text_raw) BETWEEN 150 AND 4000 ORDER BY md5(passage_id::VARCHAR), passage_id LIMIT 2000) UNION ALL SELECT node_id, 'heading', NULL FROM toc WHERE length(title) BETWEEN 15 AND 200")
def _(t):
    return indexing_rows(t.passages, t.chains, t.toc, target=2000)


@query("ds_indexing_labels", f"WITH {LABELLED} SELECT passage_id, 'unit' AS kind, count(*)::INT AS n, string_agg(left(label, 1), '' ORDER BY idx) AS labels FROM l GROUP BY 1 HAVING count(*) >= 6 AND bool_or(label = 'ISNAD') AND bool_or(label = 'MATN') UNION ALL SELECT node_id, 'heading', len(string_split(title, ' '))::INT, repeat('H', len(string_split(title, ' '))) FROM toc WHERE contains(title, ' ')")
def _(t):
    """Labelled words of the units, and of the headings, all of whose words (two or more) are HEADING."""
    words = boundary_rows(t).select("passage_id", labelled_words(F.col("text_raw"), F.col("sanad_end_raw")).alias("w"))
    has = lambda label: F.exists("w", lambda x: x["label"] == label)
    units = words.where((F.size("w") >= 6) & has("ISNAD") & has("MATN")).select("passage_id", F.lit("unit").alias("kind"), F.size("w").alias("n"), F.array_join(F.transform("w", lambda x: F.left(x["label"], F.lit(1))), "").alias("labels"))
    heads = t.toc.select(F.col("node_id").alias("passage_id"), F.lit("heading").alias("kind"), F.size(ws_tokenize(F.col("title"))).alias("n")).where("n >= 2")
    return units.unionByName(heads.withColumn("labels", F.repeat(F.lit("H"), F.col("n"))))


def pos_rows(passages: DataFrame, tags: DataFrame, least: int = 200, most: int = 2500, words: int = 8) -> DataFrame:
    """Units (passage_id, tokens, tags) of ``words`` tokens or more, with the tags (passage_id, tags) that an engine gave."""
    rows = passages.where((F.col("kind") == "unit") & F.length("text_norm").between(least, most)).select("passage_id", F.split("text_norm", " ").alias("tokens"))
    return rows.where(F.size("tokens") >= words).join(tags, "passage_id")


@query("ds_pos", "SELECT passage_id, len(string_split(text_norm, ' ')) AS n, array_to_string(list_transform(string_split(text_norm, ' '), lambda w: substr(w, 1, 1)), '') AS tags FROM passages WHERE kind = 'unit' AND length(text_norm) BETWEEN 200 AND 2500 AND len(string_split(text_norm, ' ')) >= 8")
def _(t):
    tags = t.passages.select("passage_id", F.transform(F.split("text_norm", " "), lambda w: F.left(w, F.lit(1))).alias("tags"))
    return pos_rows(t.passages, tags).select("passage_id", F.size("tokens").cast("long").alias("n"), F.array_join("tags", "").alias("tags"))


def annotate_batch(passages: DataFrame, ledger: DataFrame, layer: str, engines: list[tuple[str, Callable[[list[str]], list[str]]]], version: int = 1) -> DataFrame:
    """Payloads (passage_id, layer, engine, version, payload) of passages that the ledger lacks, by the
    first engine that works on a batch."""
    todo = passages.join(ledger.where((F.col("layer") == layer) & (F.col("version") == version)).select("passage_id"), "passage_id", "left_anti")

    def run(batches):
        for pdf in batches:
            for name, engine in engines:
                try:
                    payload = engine(pdf["text_raw"].tolist())
                except Exception:
                    if name == engines[-1][0]:
                        raise
                    continue
                yield pdf[["passage_id"]].assign(layer=layer, engine=name, version=version, payload=payload)
                break

    return todo.select("passage_id", "text_raw").mapInPandas(run, "passage_id long, layer string, engine string, version int, payload string")


def _broken(texts):
    raise RuntimeError("not installed")


@query("annotate_batch", "SELECT passage_id, 'tokens' AS layer, 'split' AS engine, 1 AS version, string_split(text_raw, ' ')[1] AS payload FROM passages WHERE passage_id % 10 <> 0")
def _(t):
    ledger = t.passages.where("passage_id % 10 = 0").select("passage_id", F.lit("tokens").alias("layer"), F.lit(1).alias("version"))
    return annotate_batch(t.passages, ledger, "tokens", [("heavy", _broken), ("split", lambda texts: [x.split(" ")[0] for x in texts])])


def merge_spans(words: DataFrame) -> DataFrame:
    """Word labels (passage_id, idx, start, end, label) as runs of one label."""
    order = Window.partitionBy("passage_id").orderBy("idx")
    runs = words.withColumn("new", F.when(F.col("label").eqNullSafe(F.lag("label").over(order)), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("passage_id", "run", "label").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("passage_id", "start", "end", "label")


def merge_bio_entities(tokens: DataFrame) -> DataFrame:
    """B-/I-/O labels (passage_id, idx, token, tag) as entities; an I- without an open entity goes."""
    order = Window.partitionBy("passage_id").orderBy("idx")
    begins = F.when(F.col("tag").startswith("B-"), 1).otherwise(0)
    breaks = F.when(F.col("tag").startswith("I-"), 0).otherwise(1)
    runs = tokens.withColumns({"begin": F.sum(begins).over(order), "break": F.sum(breaks).over(order)})
    runs = runs.where(~(F.col("tag") == "O")).withColumn("label", F.substring("tag", 3, 20))
    # a run of I- belongs to the B- right before it: the break that opened it must be that B-
    first = Window.partitionBy("passage_id", "break").orderBy("idx")
    runs = runs.withColumn("head", F.first("tag").over(first)).where(F.col("head").startswith("B-"))
    return runs.groupBy("passage_id", "break").agg(F.min("idx").alias("start_token"), F.max("idx").alias("end_token"), F.first("label").alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "token"))), lambda x: x["token"]), " ").alias("text")).drop("break")


@query("merge_spans", "SELECT chain_id AS passage_id, min(pos)::INT AS start, max(pos)::INT + 1 AS \"end\", verb AS label FROM (SELECT *, sum(new) OVER (PARTITION BY chain_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN verb IS NOT DISTINCT FROM lag(verb) OVER (PARTITION BY chain_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM links)) GROUP BY chain_id, run, verb")
def _(t):
    return merge_spans(t.links.select(F.col("chain_id").alias("passage_id"), F.col("pos").alias("idx"), F.col("pos").cast("int").alias("start"), (F.col("pos") + 1).cast("int").alias("end"), F.col("verb").alias("label")))


@query("merge_bio_entities", "WITH x AS (SELECT chain_id, pos, mention_norm, verb, count(*) FILTER (verb <> 'اخبرنا') OVER (PARTITION BY chain_id ORDER BY pos) AS g FROM links) SELECT chain_id AS passage_id, min(pos) AS start_token, max(pos) AS end_token, 'PER' AS label, string_agg(mention_norm, ' ' ORDER BY pos) AS text FROM x GROUP BY chain_id, g HAVING min_by(verb, pos) = 'حدثنا'")
def _(t):
    tag = F.when(F.col("verb") == "حدثنا", "B-PER").when(F.col("verb") == "اخبرنا", "I-PER").otherwise("O")
    return merge_bio_entities(t.links.select(F.col("chain_id").alias("passage_id"), F.col("pos").alias("idx"), F.col("mention_norm").alias("token"), tag.alias("tag")))


def aligned_output(texts: DataFrame, mark: str = "/") -> DataFrame:
    """Engine output over texts (passage_id, text, output) by token: passage_id, idx, token, made, tag, parts.

    The output has a word for each token, by position; words without a token and tokens without a word
    are left out.  ``tag`` is what follows the last ``mark`` of a word, ``parts`` what the plus signs
    of the rest part; null without a mark, or without a plus sign."""
    pairs = F.arrays_zip(F.split("text", " ").alias("token"), F.split("output", " ").alias("made"))
    both = F.least(F.size(F.split("text", " ")), F.size(F.split("output", " ")))
    rows = texts.select("passage_id", F.posexplode(F.slice(pairs, F.lit(1), both)).alias("idx", "x")).select("passage_id", "idx", "x.token", "x.made")
    tagged = F.instr("made", mark) > 0
    word = F.when(tagged, F.substring(F.col("made"), F.lit(1), F.length("made") - F.length(F.substring_index("made", mark, -1)) - len(mark))).otherwise(F.col("made"))
    return rows.withColumns({"tag": F.when(tagged, F.substring_index("made", mark, -1)), "parts": F.when(F.instr(word, "+") > 0, F.split(word, r"\+"))})


@query("align_word_tags", "SELECT passage_id, i - 1 AS idx, w[i] AS token, substr(w[i], 1, 2) AS tag FROM (SELECT passage_id, string_split(text_norm, ' ') AS w FROM passages) p, range(1, 400) r(i) WHERE i <= len(w) AND i <= len(w) - passage_id % 2")
def _(t):
    """Words with their first letters as tags; every other text has a word less."""
    words = F.split("text_norm", " ")
    made = F.array_join(F.transform(F.slice(words, F.lit(1), F.size(words) - (F.col("passage_id") % 2).cast("int")), lambda w: F.concat(w, F.lit("/"), F.substring(w, 1, 2))), " ")
    rows = aligned_output(t.passages.where(F.size(words) > F.col("passage_id") % 2).select("passage_id", F.col("text_norm").alias("text"), made.alias("output")))
    return rows.select("passage_id", F.col("idx").cast("long").alias("idx"), "token", "tag")


@query("align_word_parts", "SELECT passage_id, i - 1 AS idx, w[i] AS token, CASE WHEN w[i][1:2] = 'ال' AND len(w[i]) > 2 THEN ['ال', w[i][3:]] END AS parts FROM (SELECT passage_id, string_split(text_norm, ' ') AS w FROM passages) p, range(1, 400) r(i) WHERE i <= len(w)")
def _(t):
    """The article parted from its word."""
    made = F.array_join(F.transform(F.split("text_norm", " "), lambda w: F.regexp_replace(w, "^ال(?=.)", "ال+")), " ")
    rows = aligned_output(t.passages.select("passage_id", F.col("text_norm").alias("text"), made.alias("output")))
    return rows.select("passage_id", F.col("idx").cast("long").alias("idx"), "token", "parts")


def picked_analyses(analyses: DataFrame, keys: list[str]) -> DataFrame:
    """Of the analyses (``keys``, word, place, diac, ...) of each token the first by place whose normalised
    form is that of the word, else the first."""
    agrees = normalize_arabic(F.col("diac")) == normalize_arabic(F.col("word"))
    order = F.struct((~agrees).cast("int").alias("unlike"), F.col("place"))
    rest = [c for c in analyses.columns if c not in keys]
    return analyses.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


@query("pick_analysis", "WITH l AS (SELECT *, first_value(mention_norm) OVER (PARTITION BY chain_id ORDER BY pos DESC) AS word FROM links) SELECT chain_id, pos FROM (SELECT chain_id, pos, row_number() OVER (PARTITION BY chain_id ORDER BY CASE WHEN mention_norm = word THEN 0 ELSE 1 END, pos) AS rn FROM l) WHERE rn = 1")
def _(t):
    """The links of a chain as analyses of its last mention, with marks that the comparison takes away."""
    last = t.links.groupBy("chain_id").agg(F.max_by("mention_norm", "pos").alias("word"))
    forms = t.links.join(last, "chain_id").select("chain_id", "word", F.col("pos").alias("place"), F.replace("mention_norm", F.lit("ن"), F.lit("نُ")).alias("diac"))
    return picked_analyses(forms, ["chain_id"]).select("chain_id", F.col("place").alias("pos"))


def usable_spans(spans: F.Column, isnad: int = 30, matn: int = 40) -> F.Column:
    """Whether spans (start, end, label) have so many characters of each of the two parts, at least."""
    chars = lambda label: F.aggregate(F.filter(spans, lambda s: s["label"] == label), F.lit(0), lambda x, s: x + s["end"] - s["start"])
    return (chars("ISNAD") >= isnad) & (chars("MATN") >= matn)


@query("usable_spans", "SELECT passage_id FROM chains WHERE sanad_end_raw >= 30 AND passage_id IN (SELECT passage_id FROM passages p WHERE length(text_norm) - (SELECT sanad_end_raw FROM chains c WHERE c.passage_id = p.passage_id) >= 40)")
def _(t):
    rows = t.passages.join(t.chains.select("passage_id", "sanad_end_raw"), "passage_id").where("sanad_end_raw is not null")
    span = lambda a, b, label: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(label).alias("label"))
    spans = F.array(span(F.lit(0), F.col("sanad_end_raw"), "ISNAD"), span(F.col("sanad_end_raw"), F.length("text_norm"), "MATN"))
    return rows.select("passage_id", spans.alias("spans")).where(usable_spans(F.col("spans"))).select("passage_id")


def tagger_eval(pairs: DataFrame) -> DataFrame:
    """(passage_id, gold, pred) label arrays: word accuracy, boundary within two words, median boundary error."""
    words = pairs.select(F.inline(F.arrays_zip("gold", "pred"))).where("gold is not null")
    total = words.agg(F.count("*").alias("tokens"), F.round(F.avg((F.col("gold").eqNullSafe(F.col("pred"))).cast("double")), 6).alias("accuracy"))
    cut = lambda c: F.array_position(c, "MATN")
    errors = pairs.where(F.array_contains("gold", "ISNAD") & F.array_contains("gold", "MATN")).select(F.when(cut("pred") > 0, F.abs(cut("pred") - cut("gold"))).alias("e"))
    bounds = errors.agg(F.count("*").alias("boundaries"), F.round(F.count_if(F.col("e") <= 2) / F.count("*"), 6).alias("within_two"), F.expr("percentile_disc(0.5) within group (order by e)").cast("long").alias("median_error"))
    return total.crossJoin(bounds)


@query("tagger_eval", "WITH g AS (SELECT chain_id, pos, CASE WHEN verb = 'عن' THEN 'MATN' ELSE 'ISNAD' END AS gold, CASE WHEN (chain_id + pos) % 5 = 0 THEN 'MATN' WHEN verb = 'عن' THEN 'MATN' ELSE 'ISNAD' END AS pred, row_number() OVER (PARTITION BY chain_id ORDER BY pos) AS i FROM links), b AS (SELECT chain_id, min(i) FILTER (gold = 'MATN') AS g, min(i) FILTER (pred = 'MATN') AS p FROM g GROUP BY 1 HAVING count_if(gold = 'MATN') > 0 AND count_if(gold = 'ISNAD') > 0) SELECT (SELECT count(*) FROM g) AS tokens, (SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0 END), 6) FROM g) AS accuracy, count(*) AS boundaries, round(count_if(abs(p - g) <= 2)::DOUBLE / count(*), 6) AS within_two, percentile_disc(0.5) WITHIN GROUP (ORDER BY abs(p - g)) AS median_error FROM b")
def _(t):
    gold = F.when(F.col("verb") == "عن", "MATN").otherwise("ISNAD")
    pred = F.when((F.col("chain_id") + F.col("pos")) % 5 == 0, "MATN").otherwise(gold)
    listed = F.array_sort(F.collect_list(F.struct("pos", gold.alias("gold"), pred.alias("pred"))))
    rows = t.links.groupBy(F.col("chain_id").alias("passage_id")).agg(listed.alias("x"))
    return tagger_eval(rows.select("passage_id", F.transform("x", lambda r: r["gold"]).alias("gold"), F.transform("x", lambda r: r["pred"]).alias("pred")))


def mark_errors(pairs: DataFrame) -> DataFrame:
    """(gold, pred) arrays of mark classes: error rates of all letters (der_all) and of those that have a mark (der_marked)."""
    letters = pairs.select(F.inline(F.arrays_zip("gold", "pred"))).where("gold is not null")
    wrong = ~F.col("gold").eqNullSafe(F.col("pred"))
    rate = lambda of: F.round(F.count_if(wrong & of) / F.greatest(F.count_if(of), F.lit(1)), 6)
    return letters.agg(rate(F.lit(True)).alias("der_all"), rate(F.col("gold") > 0).alias("der_marked"), F.count("*").alias("chars"))


MARK_PAIRS = "SELECT CASE verb WHEN 'عن' THEN 0 WHEN 'حدثنا' THEN 1 ELSE 2 END AS gold, CASE WHEN (chain_id + pos) % 7 = 0 THEN 0 WHEN verb = 'عن' THEN 0 WHEN verb = 'حدثنا' THEN 1 ELSE 2 END AS pred FROM links"


@query("mark_errors", f"SELECT round(count_if(gold <> pred)::DOUBLE / count(*), 6) AS der_all, round(count_if(gold <> pred AND gold > 0)::DOUBLE / count_if(gold > 0), 6) AS der_marked, count(*) AS chars FROM ({MARK_PAIRS})")
def _(t):
    gold = F.when(F.col("verb") == "عن", 0).when(F.col("verb") == "حدثنا", 1).otherwise(2)
    pred = F.when((F.col("chain_id") + F.col("pos")) % 7 == 0, 0).otherwise(gold)
    listed = F.array_sort(F.collect_list(F.struct("pos", gold.alias("gold"), pred.alias("pred"))))
    rows = t.links.groupBy("chain_id").agg(listed.alias("x"))
    return mark_errors(rows.select(F.transform("x", lambda r: r["gold"]).alias("gold"), F.transform("x", lambda r: r["pred"]).alias("pred")))


def confusion_pairs(pairs: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` most frequent (gold, pred) labels that differ, of arrays of labels."""
    words = pairs.select(F.inline(F.arrays_zip("gold", "pred"))).where("gold <> pred")
    return words.groupBy("gold", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold", "pred").limit(n)


@query("confusion_pairs", f"SELECT gold, pred, count(*) AS n FROM ({MARK_PAIRS}) WHERE gold <> pred GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 8")
def _(t):
    gold = F.when(F.col("verb") == "عن", 0).when(F.col("verb") == "حدثنا", 1).otherwise(2)
    pred = F.when((F.col("chain_id") + F.col("pos")) % 7 == 0, 0).otherwise(gold)
    rows = t.links.groupBy("chain_id").agg(F.collect_list(F.struct(gold.alias("gold"), pred.alias("pred"))).alias("x"))
    return confusion_pairs(rows.select(F.transform("x", lambda r: r["gold"]).alias("gold"), F.transform("x", lambda r: r["pred"]).alias("pred")))
