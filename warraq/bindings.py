"""The corpus model over the supplied tables: each view is one SQL text for Spark and for DuckDB.

Links are order lines (chain = order, position = line number, so gaps occur), narrators are
suppliers, passages are orders with a text synthesised from their chain, editions and works come
from nations, subjects from part sizes, and the TOC tree from region, nation and customer.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from warraq.sources.folders import shuffled

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def pick(expr: str, *items: str | None) -> str:
    """The item numbered ``expr``, in either dialect."""
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if x is None else f"'{x}'") for i, x in enumerate(items))
    return f"(CASE CAST({expr} AS INT) {cases} END)"


NAMES = ("محمد", "احمد", "سفيان", "مالك", "نافع", "شعبه", "هشام", "يحيي", "عمرو", "ابراهيم", "علي", "حماد")
FATHERS = ("عيينه", "انس", "عمر", "الحجاج", "عروه", "سعيد", "دينار", "يزيد", "سلمه", "زيد")
GRADES = (
    "ثقه ثبت", "ثقه", "صدوق يهم", "صدوق", "مقبول", "ضعيف", "متروك", None, "صحابي جليل", "لين الحديث", "مجهول الحال", "كذاب", "لا باس به", "متفق علي توثيقه", "امام", "لا يعرف",
)
VERBS = ("حدثنا", "اخبرنا", "عن")
MATNS = (
    "قَالَ رسول الله انما الاعمال بالنيات هذا حديث حسن صحيح",
    "قال النبي شهدت بدر مع رسول الله",
    "كان رسول الله يصوم في رمضان ويقوم ليله القدر",
    "سمعت عمر يقول انا لا ندخل يوم الدار اسناده ضعيف",
    "رايت النبي توضا ثلاثا هذا حديث غريب",
    "قال الله انا عند ظن عبدي بي",
    "لا باس به في البيع",
    "نهي عن ذلك عام الفتح فتح مكه صحيح علي شرط مسلم",
    "خرجنا يوم النحر الي مني",
    "قال كنا يوم الجمل معه",
    "صلي صلاه العيد ثم خطب هذا حديث حسن غريب",
    "ان النبي صلي الله عليه وسلم بعث سريه",
    "كان لا يري به باسا ولم يخرجاه",
    "غزونا تبوك وحجه الوداع مع رسول الله هذا حديث منكر",
    "لما قتل عمر اجتمع الناس",
    "سالته عن الرجل يطلق امراته هذا حديث حسن",
)

#: Marks that normalisation removes, and the letters that it unifies.  Fixed values.
MARKS = "\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e8\u06ea-\u06ed\u0640"
UNIFIED = ("آأإٱةىؤئ", "ااااهيءء")


def views(duckdb: bool) -> dict[str, str]:
    """SQL by view name; supplied tables and earlier views are in braces."""
    every = ", 'g'" if duckdb else ""
    joined = (lambda x, by: f"string_agg({x}, ' ' ORDER BY {by})") if duckdb else (lambda x, by: f"listagg({x}, ' ') WITHIN GROUP (ORDER BY {by})")
    array = (lambda *x: f"[{', '.join(x)}]") if duckdb else (lambda *x: f"array({', '.join(x)})")
    name = lambda k: f"concat({pick(f'{k} % 12', *NAMES)}, ' بن ', {pick(f'floor({k} / 12) % 10', *FATHERS)})"
    fold = lambda x: f"trim(regexp_replace(translate(regexp_replace({x}, '[{MARKS}]', ''{every}), '{UNIFIED[0]}', '{UNIFIED[1]}'), '[ \\t\\n]+', ' '{every}))"
    if not duckdb:
        fold = lambda x: f"trim(regexp_replace(translate(regexp_replace({x}, '[{MARKS}]', ''), '{UNIFIED[0]}', '{UNIFIED[1]}'), '[ \\\\t\\\\n]+', ' '))"
    return {
        "narrators": f"""SELECT s_suppkey AS narrator_id, {name('s_suppkey')} AS canonical_ar, {name('s_suppkey')} AS canonical_norm,
            {pick('s_suppkey % 5', 'صحابي', 'تابعي', 'من أتباع التابعين', 'من تبع الأتباع', None)} AS generation,
            CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(30 + s_suppkey % 270 AS INT) END AS death_year_h,
            {array("concat('place', CAST(s_nationkey AS VARCHAR(9)))", "concat('place', CAST(s_suppkey % 7 AS VARCHAR(9)))")} AS places,
            {pick('s_suppkey % 16', *GRADES)} AS rijal_grade,
            {pick('s_suppkey % 14', *(str(k) for k in range(1, 13)), 'x', None)} AS tabaqa_no, {pick('(s_suppkey % 14 + floor(s_suppkey / 14) % 3) % 4', 'الكبار', 'الوسطى', 'الصغار', None)} AS tabaqa_label FROM {{supplier}}""",
        "aliases": f"""SELECT s_suppkey AS narrator_id, concat({pick('s_suppkey % 12', *NAMES)}, ' ابن ', {pick('floor(s_suppkey / 12) % 10', *FATHERS)}) AS alias_norm FROM {{supplier}}
            UNION ALL SELECT s_suppkey, concat('ابو ', {pick('s_suppkey % 12', *NAMES)}) FROM {{supplier}} WHERE s_suppkey % 3 = 0""",
        "links": f"""SELECT l_orderkey + 10000000 AS chain_id, l_linenumber AS pos, CASE WHEN min(l_suppkey) % 17 = 0 THEN NULL ELSE min(l_suppkey) END AS narrator_id,
            {pick("CASE min(l_returnflag) WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END", *VERBS)} AS verb, {name('min(l_suppkey)')} AS mention_ar, {name('min(l_suppkey)')} AS mention_norm
            FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber""",
        "works": f"""SELECT n_nationkey AS work_id, concat('كتاب ', n_name) AS title_ar, lower(concat('كتاب ', n_name)) AS title_norm,
            {pick('n_nationkey % 6', 'matn', 'matn', 'rijal', 'sharh', 'matn', 'service')} AS kind FROM {{nation}}""",
        "editions": """SELECT n_nationkey * 2 AS edition_id, n_nationkey AS work_id, 'units' AS source, n_nationkey AS source_book_id, n_name AS title_ar, 'matn' AS book_type FROM {nation}
            UNION ALL SELECT n_nationkey * 2 + 1, n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN 'archive' ELSE 'pages' END, n_nationkey, n_name, 'page-archive' FROM {nation}""",
        "chain_texts": f"SELECT chain_id, {joined('concat(verb, chr(32), mention_ar)' if duckdb else 'concat(verb, char(32), mention_ar)', 'pos')} AS sanad FROM {{links}} GROUP BY chain_id",
        "passages": f"""SELECT passage_id, edition_id, kind, seq, unit_num, part, page, text_raw, {fold('text_raw')} AS text_norm FROM (
            SELECT o_orderkey AS passage_id, CAST((o_custkey % 25) * 2 + o_orderkey % 2 AS INT) AS edition_id, CASE WHEN o_orderstatus = 'P' THEN 'page' ELSE 'unit' END AS kind,
            o_orderkey AS seq, CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(o_orderkey % 3000 AS VARCHAR(9)) END AS unit_num,
            CAST(o_orderkey % 9 AS VARCHAR(9)) AS part, CAST(o_custkey % 400 AS VARCHAR(9)) AS page,
            concat(CASE WHEN sanad IS NULL THEN '' ELSE concat(sanad, ' ') END, {pick(f'o_orderkey % {len(MATNS)}', *MATNS)}) AS text_raw FROM {{orders}} LEFT JOIN {{chain_texts}} ON chain_id = o_orderkey + 10000000) AS t""",
        "chains": f"""SELECT o_orderkey + 10000000 AS chain_id, o_orderkey AS passage_id, 0 AS ord, round(o_totalprice / 500000, 4) AS confidence,
            CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN -1 ELSE CAST(o_orderkey % 60 AS INT) END AS sanad_end_raw,
            CASE o_orderkey % 4 WHEN 0 THEN {array("'dropped_mention'", "'speech_boundary'")} WHEN 1 THEN {array("'no_matn_marker'")} WHEN 2 THEN {array("'speech_boundary'")} ELSE {array("'-'")} END AS flags
            FROM {{orders}} WHERE o_orderkey IN (SELECT l_orderkey FROM {{lineitem}})""",
        "subjects": f"""SELECT DISTINCT p_size AS subject_id, CASE WHEN p_size <= 5 THEN NULL ELSE CAST(p_size % 5 + 1 AS INT) END AS parent_id,
            concat('موضوع ', CAST(p_size AS VARCHAR(9))) AS title, concat('موضوع ', CAST(p_size AS VARCHAR(9))) AS title_norm, p_size AS ord FROM {{part}}""",
        "subject_links": "SELECT DISTINCT p_size AS subject_id, l_orderkey AS passage_id FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
        "grades": f"""SELECT o_orderkey AS passage_id, {pick("CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END", 'sahih', 'hasan', 'daif')} AS grade_norm,
            CASE WHEN o_orderkey % 3 = 0 THEN 'book-convention' ELSE 'matn-text' END AS source FROM {{orders}} WHERE o_orderpriority <> '5-LOW'""",
        "types": f"""SELECT o_orderkey AS passage_id, {pick('o_custkey % 6', 'qudsi', 'marfu_qawli', 'marfu_fili', 'marfu', 'mawquf', 'maqtu')} AS type_norm, 0.5 + (o_custkey % 4) / 10.0 AS confidence
            FROM {{orders}} WHERE o_custkey % 7 <> 6""",
        "dates": f"""SELECT o_orderkey AS passage_id, CAST(o_custkey % 12 - 13 AS INT) AS year_min, CAST(o_custkey % 12 + o_orderkey % 3 AS INT) AS year_max,
            CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 12 AS INT) END AS year_best, {pick('o_orderkey % 4', 'event', 'companion', 'season', 'companion')} AS basis,
            CASE WHEN o_orderkey % 4 = 0 THEN {pick('o_custkey % 3', 'badr', 'uhud', 'tabuk')} END AS event_key, CASE WHEN o_orderkey % 6 = 2 THEN {pick('o_custkey % 2', 'ramadan', 'hajj')} END AS season,
            CASE WHEN o_orderkey % 2 = 1 THEN {pick('o_custkey % 4', 'anas', 'jabir', 'aisha', 'ali')} END AS companion_key FROM {{orders}} WHERE o_orderkey % 5 <> 0""",
        "toc": """SELECT CAST(r_regionkey AS BIGINT) AS node_id, CAST(-1 AS BIGINT) AS parent_id, r_name AS title, 1 AS edition_id, CAST(r_regionkey AS BIGINT) AS ord FROM {region}
            UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), n_name, 1, CAST(100 + n_nationkey AS BIGINT) FROM {nation}
            UNION ALL SELECT CAST(1000 + c_custkey AS BIGINT), CAST(100 + c_nationkey AS BIGINT), c_name, 1, CAST(1000 + c_custkey AS BIGINT) FROM {customer}""",
    }


SPARK_VIEWS, DUCKDB_VIEWS = views(False), views(True)


def with_views(sql: str) -> str:
    """``sql`` with the definitions of the views it names, and of those they name, before it."""
    needed: list[str] = []

    def add(text: str):
        for v in DUCKDB_VIEWS:
            if v not in needed and re.search(rf"\b{v}\b", text):
                add(DUCKDB_VIEWS[v])
                if v not in needed:
                    needed.append(v)

    add(sql)
    if not needed:
        return sql
    heads = [f"{v} AS ({re.sub(r'[{](\w+)[}]', r'\1', DUCKDB_VIEWS[v])})" for v in needed]
    recursive, sql = ("RECURSIVE ", sql.strip()[len("WITH RECURSIVE"):]) if sql.strip().startswith("WITH RECURSIVE") else ("", sql)
    if recursive:
        return f"WITH RECURSIVE {', '.join(heads)}, {sql}"
    if sql.strip().startswith("WITH "):
        return f"WITH {', '.join(heads)}, {sql.strip()[5:]}"
    return f"WITH {', '.join(heads)} {sql}"


_persisted: dict[tuple[str, str], DataFrame] = {}
_postings: dict[tuple[str, str], DataFrame] = {}


class Tables:
    """The supplied tables and the views over them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    @property
    def postings(self) -> DataFrame:
        """The postings of the passages' words, written once for a session and folder."""
        from warraq.operators.postings import text_postings

        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _postings:
            _postings[key] = text_postings(self.passages)
        return _postings[key]

    def _stored(self, name: str, make) -> DataFrame:
        """The passages are a table with their normalised text, not an expression of every query: they
        are persisted once for a session and folder (spilling to disk, and recomputed if lost)."""
        if name != "passages":
            return make()
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _persisted:
            for old in _persisted.values():
                old.unpersist()
            _persisted.clear()
            _persisted[key] = make().persist()
        return _persisted[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in SPARK_VIEWS:
                sql = SPARK_VIEWS[name]
                parts = {x: getattr(self, x) for x in set(re.findall(r"[{](\w+)[}]", sql))}
                if name == "chains":  # one column of a compressed file looks small, but has millions of keys
                    parts["lineitem"] = shuffled(parts["lineitem"])
                self._made[name] = self._stored(name, lambda: self.spark.sql(sql, **parts))
            else:
                raise AttributeError(name)
        return self._made[name]

    def unkept(self, name: str) -> DataFrame:
        """The view ``name`` for a query that reads it once: only the columns that it asks for are made, and
        nothing is persisted (what the session has persisted before is still used)."""
        sql = SPARK_VIEWS[name]
        return self.spark.sql(sql, **{x: getattr(self, x) for x in set(re.findall(r"[{](\w+)[}]", sql))})
