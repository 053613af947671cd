"""Queries of the scans, parsers and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..functions import text as T
from ..registry import literal_rows, query, table


@query("docs_scan", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE n_chars >= 100 GROUP BY ALL")
def docs_scan(spark, sf):
    return table(spark, sf, "documents").filter("n_chars >= 100").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("pages_scan", "SELECT page_id, url, length(html)::BIGINT AS n_chars, sha256(html) AS html_sha FROM pages")
def pages_scan(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"), F.sha2("html", 256).alias("html_sha"))


@query("ticker_map_scan", "SELECT lpad(s_suppkey::VARCHAR, 10, '0') AS cik, s_name AS title, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def ticker_map_scan(spark, sf):
    """A JSON object keyed by position, one per nation, back to rows."""
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    packed = rows.groupBy("n_name").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), F.struct("s_suppkey", "s_name"))))).alias("raw"))
    entry = F.explode(F.map_values(F.from_json("raw", "map<string, struct<s_suppkey: long, s_name: string>>"))).alias("e")
    return packed.select("n_name", entry).select(F.lpad(F.col("e.s_suppkey").cast("string"), 10, "0").alias("cik"), F.col("e.s_name").alias("title"), F.col("n_name").alias("nation"))


@query("columnar_json_rows", "SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_orderstatus AS status FROM orders")
def columnar_json_rows(spark, sf):
    """Structs of parallel arrays (a recent page and older pages) zipped to rows and united."""
    orders = table(spark, sf, "orders").withColumn("page", F.col("o_orderkey") % 3)
    columnar = orders.groupBy("o_custkey", "page").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("r"))
    arrays = columnar.select("o_custkey", "page", F.transform("r", lambda x: x.o_orderkey).alias("orderkey"), F.transform("r", lambda x: x.o_orderstatus).alias("status"))
    rows = lambda p: arrays.filter(p).select(F.col("o_custkey").alias("custkey"), F.inline(F.arrays_zip("orderkey", "status")))
    return rows("page = 0").unionByName(rows("page > 0"))


@query("content_addressed_dedup", "SELECT sha256(text) AS text_sha, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE doc_id % 4 <> 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0) GROUP BY 1")
def content_addressed_dedup(spark, sf):
    """Texts that a content-addressed cache (a quarter of the corpus) lacks, each once."""
    keyed = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha"))
    cached, asked = keyed.filter("doc_id % 4 = 0").select("text_sha"), keyed.filter("doc_id % 4 <> 0")
    return asked.join(cached, "text_sha", "left_anti").groupBy("text_sha").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("layered_cache", """WITH a AS (SELECT event_id, value FROM events WHERE event_id % 3 = 0), b AS (SELECT event_id, value + 1 AS value FROM events WHERE event_id % 2 = 0)
SELECT e.event_id, coalesce(a.value, b.value) AS response, CASE WHEN a.value IS NOT NULL THEN 'read_only' WHEN b.value IS NOT NULL THEN 'writable' ELSE 'miss' END AS layer
FROM events e LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id)""")
def layered_cache(spark, sf):
    """Read-only layer first, then the writable one."""
    asked = table(spark, sf, "events").select("event_id", "value")
    fixed = asked.filter("event_id % 3 = 0").select("event_id", F.col("value").alias("ro"))
    own = asked.filter("event_id % 2 = 0").select("event_id", (F.col("value") + 1).alias("rw"))
    joined = asked.select("event_id").join(fixed, "event_id", "left").join(own, "event_id", "left")
    layer = F.when(F.col("ro").isNotNull(), "read_only").when(F.col("rw").isNotNull(), "writable").otherwise("miss")
    return joined.select("event_id", F.coalesce("ro", "rw").alias("response"), layer.alias("layer"))


PROMPTS = [("p1", "---\nversion: 1\n---\n# system\nbe brief\n# user\n{question}\n{context}"), ("p2", "# system\n{question}\n# user\n{context}"), ("p3", "# system\nx\n# user\n{question} {question} {context}"), ("p4", "# user\n{question}{context}")]
_PROMPT_VALUES = ", ".join(f"('{i}', '{t.replace(chr(10), chr(92) + 'n')}')" for i, t in PROMPTS)


@query("prompt_registry", f"""WITH p(prompt_id, raw) AS (VALUES {_PROMPT_VALUES}), t AS (SELECT prompt_id, replace(raw, '\\n', chr(10)) AS raw FROM p),
s AS (SELECT *, len(regexp_extract_all(raw, '(?m)^# system$')) AS ns, len(regexp_extract_all(raw, '(?m)^# user$')) AS nu, split_part(raw, '# user', 2) AS u, split_part(raw, '# user', 1) AS before_user FROM t)
SELECT prompt_id, sha256(raw) AS file_sha, ns = 1 AND nu = 1 AS sections_ok, len(regexp_extract_all(u, '\\{{question\\}}')) = 1 AND len(regexp_extract_all(u, '\\{{context\\}}')) = 1 AND NOT contains(before_user, '{{question}}') AND NOT contains(before_user, '{{context}}') AS placeholders_ok FROM s""")
def prompt_registry(spark, sf):
    """Prompt files: one system and one user section, each placeholder once and only in the user section."""
    raw = F.col("raw")
    count = lambda text, what: F.size(F.regexp_extract_all(text, F.lit(what), F.lit(0)))
    before, user = F.split_part(raw, F.lit("# user"), F.lit(1)), F.split_part(raw, F.lit("# user"), F.lit(2))
    placed = F.lit(True)
    for name in ("{question}", "{context}"):
        placed = placed & (count(user, "\\" + name.replace("}", "\\}")) == 1) & ~F.contains(before, F.lit(name))
    sections = (count(raw, "(?m)^# system$") == 1) & (count(raw, "(?m)^# user$") == 1)
    return literal_rows(spark, PROMPTS, "prompt_id string, raw string").select("prompt_id", F.sha2(raw, 256).alias("file_sha"), sections.alias("sections_ok"), placed.alias("placeholders_ok"))


@query("release_manifest", r"""SELECT doc_id, sha256(text) AS sha, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS has_email, regexp_matches(text, '(AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{20,})') AS has_secret FROM documents""")
def release_manifest(spark, sf):
    """Checksums of a release and what must not be in it."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("sha"), F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("has_email"), F.col("text").rlike(r"AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{20,}").alias("has_secret"))


@query("strip_wrapper", r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'HEADER' || chr(10) || html || 'TRAILER' WHEN page_id % 3 = 1 THEN substr(html, 16) ELSE html END AS raw FROM pages),
a AS (SELECT page_id, raw, instr(lower(raw), '<html') AS i FROM p), b AS (SELECT *, CASE WHEN i > 0 THEN instr(substr(lower(raw), i), '</html>') ELSE 0 END AS j FROM a)
SELECT page_id, sha256(CASE WHEN i = 0 THEN raw WHEN j = 0 THEN substr(raw, i) ELSE substr(raw, i, j + 6) END) AS body_sha FROM b""")
def strip_wrapper(spark, sf):
    html = F.col("html")
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("HEADER\n"), html, F.lit("TRAILER"))).when(F.col("page_id") % 3 == 1, F.substring(html, 16, 10**9)).otherwise(html)
    return table(spark, sf, "pages").select("page_id", F.sha2(T.strip_wrapper(raw), 256).alias("body_sha"))


#: Small tables for every customer: a row for each order, with cells whose forms depend on its key.
_CELLS = """CASE o_orderkey % 4 WHEN 0 THEN [o_orderstatus, '$' || o_orderkey, '(' || (o_orderkey % 100) || ')'] WHEN 1 THEN [o_orderstatus || chr(10) || 'of', 'n. ' || o_orderkey, ''] WHEN 2 THEN ['-' || o_orderkey, o_orderpriority, 'x'] ELSE ['total', 'is', (o_orderkey % 90) || '.5 %'] END"""
_TABLE_ROWS = f"t AS (SELECT o_custkey AS table_id, o_orderkey AS row_no, {_CELLS} AS cells FROM orders)"


def order_cells(spark, sf):
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    row = (
        F.when(key % 4 == 0, F.array(F.col("o_orderstatus"), F.concat(F.lit("$"), text), F.concat(F.lit("("), (key % 100).cast("string"), F.lit(")"))))
        .when(key % 4 == 1, F.array(F.concat(F.col("o_orderstatus"), F.lit("\nof")), F.concat(F.lit("n. "), text), F.lit("")))
        .when(key % 4 == 2, F.array(F.concat(F.lit("-"), text), F.col("o_orderpriority"), F.lit("x")))
        .otherwise(F.array(F.lit("total"), F.lit("is"), F.concat((key % 90).cast("string"), F.lit(".5 %"))))
    )
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("table_id"), key.alias("row_no"), row.alias("cells"))


@query("table_serialise", f"WITH {_TABLE_ROWS} SELECT table_id, string_agg(replace(array_to_string(cells, ' | '), chr(10), ' '), chr(10) ORDER BY row_no) AS body FROM t GROUP BY table_id")
def table_serialise(spark, sf):
    line = F.array_join(F.transform("cells", lambda c: F.replace(c, F.lit("\n"), F.lit(" "))), " | ")
    return order_cells(spark, sf).select("table_id", F.struct("row_no", line.alias("line")).alias("r")).groupBy("table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x.line), "\n").alias("body"))


@query("table_classifier", f"""WITH {_TABLE_ROWS}, c AS (SELECT table_id, row_no, replace(unnest(cells), ' ', '') AS cell, len(cells) AS width FROM t), f AS (SELECT *, ltrim(cell[1:1], '$(-') || cell[2:] AS body FROM c),
g AS (SELECT *, rtrim(rtrim(body, '%'), ')') AS core FROM f)
SELECT table_id, count(DISTINCT row_no) >= 2 AND max(width) >= 2 AND coalesce(avg(CASE WHEN cell <> '' THEN (len(core) > 0 AND TRY_CAST(replace(core, ',', '') AS DOUBLE) IS NOT NULL)::INT END) >= 0.25, false) AS is_data_table FROM g GROUP BY table_id""")
def table_classifier(spark, sf):
    """Two rows and columns at least, and a quarter of the filled cells numeric; negative amounts are numeric."""
    cells = order_cells(spark, sf).select("table_id", "row_no", F.size("cells").alias("width"), F.explode("cells").alias("cell")).withColumn("cell", F.replace("cell", F.lit(" "), F.lit("")))
    numeric = F.when(F.col("cell") != "", F.col("cell").rlike(r"^[-$(]?[0-9,]+(\.[0-9]*)?\)?%?$").cast("int"))
    return cells.groupBy("table_id").agg(((F.countDistinct("row_no") >= 2) & (F.max("width") >= 2) & F.coalesce(F.avg(numeric) >= 0.25, F.lit(False))).alias("is_data_table"))


_LINES = r"""lines AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)),
kept AS (SELECT * FROM lines WHERE line <> '')"""


def line_blocks(docs):
    """Non-empty trimmed lines of every text with their place."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.trim("line", F.lit(" \t\r")).alias("line")).filter("line <> ''")


def with_offsets(blocks, by="doc_id", text="line", order="pos", gap=2):
    """Offsets of blocks joined by a separator of ``gap`` characters."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0)).cast("bigint")
    return blocks.withColumn("char_start", start).withColumn("char_end", start + F.length(text))


@query("line_block_offsets", f"WITH {_LINES} SELECT doc_id, pos, s AS char_start, s + length(line) AS char_end FROM (SELECT doc_id, pos, line, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM kept)")
def line_block_offsets(spark, sf):
    return with_offsets(line_blocks(table(spark, sf, "documents"))).select("doc_id", "pos", "char_start", "char_end")


@query("section_carry_forward", f"""WITH {_LINES}, h AS (SELECT doc_id, pos, length(line) <= 40 AND NOT contains(line, '.') AS is_header, line FROM kept)
SELECT doc_id, pos, is_header, last_value(CASE WHEN is_header THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h""")
def section_carry_forward(spark, sf):
    """Short lines without a full stop act as headers; a block's section is the last header, its own included."""
    blocks = line_blocks(table(spark, sf, "documents")).withColumn("is_header", (F.length("line") <= 40) & ~F.contains("line", F.lit(".")))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.select("doc_id", "pos", "is_header", F.last(F.when(F.col("is_header"), F.col("line")), ignorenulls=True).over(w).alias("section"))


@query("page_counter", f"WITH {_LINES} SELECT doc_id, pos, 1 + coalesce(sum((pos % 7 = 3)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)::BIGINT + coalesce(sum((pos % 5 = 4)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page FROM kept")
def page_counter(spark, sf):
    """Breaks before a block count from it on, breaks after a block from the next one on."""
    blocks = line_blocks(table(spark, sf, "documents"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.sum((F.col("pos") % 7 == 3).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.sum((F.col("pos") % 5 == 4).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return blocks.select("doc_id", "pos", (1 + F.coalesce(before, F.lit(0)) + F.coalesce(after, F.lit(0))).alias("page"))


@query("merge_documents", f"""WITH {_LINES}, p AS (SELECT doc_id // 3 AS merged, doc_id, pos, line, pos // 4 + 1 AS page FROM kept), m AS (SELECT merged, doc_id, max(page) AS pages FROM p GROUP BY ALL),
s AS (SELECT merged, doc_id, coalesce(sum(pages) OVER (PARTITION BY merged ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM m),
o AS (SELECT p.*, s.shift, coalesce(sum(length(line) + 2) OVER (PARTITION BY p.merged ORDER BY p.doc_id, p.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM p JOIN s USING (merged, doc_id))
SELECT merged::BIGINT AS merged, doc_id, pos, (page + shift)::BIGINT AS page, char_start FROM o""")
def merge_documents(spark, sf):
    """Parts of a document one after the other: pages run on, offsets are counted anew."""
    blocks = line_blocks(table(spark, sf, "documents")).withColumn("merged", F.floor(F.col("doc_id") / 3)).withColumn("page", F.floor(F.col("pos") / 4) + 1)
    pages = blocks.groupBy("merged", "doc_id").agg(F.max("page").alias("pages"))
    before = lambda *order: Window.partitionBy("merged").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    shift = pages.select("merged", "doc_id", F.coalesce(F.sum("pages").over(before("doc_id")), F.lit(0)).alias("shift"))
    joined = blocks.join(shift, ["merged", "doc_id"])
    start = F.coalesce(F.sum(F.length("line") + 2).over(before("doc_id", "pos")), F.lit(0)).cast("bigint")
    return joined.select("merged", "doc_id", "pos", (F.col("page") + F.col("shift")).alias("page"), start.alias("char_start"))


@query("cover_period", "SELECT o_orderkey, (strftime(o_orderdate, '%Y-%m-%d'))::VARCHAR AS period_end FROM orders")
def cover_period(spark, sf):
    orders = table(spark, sf, "orders")
    cover = F.concat(F.lit("FORM 10-K for the fiscal year ended "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" Commission file"))
    return orders.select("o_orderkey", T.cover_period(cover).cast("string").alias("period_end"))


_ENDINGS = ("", " Corp.", " CORPORATION /DE", " Co., Inc.", " Holdings Group Ltd", " Company", " & Sons LLC", " Limited")


@query("company_normalise", "SELECT c_custkey AS id, 'CUSTOMER' || lpad(c_custkey::VARCHAR, 9, '0') || CASE WHEN c_custkey % 8 = 6 THEN 'SONS' ELSE '' END AS company_key FROM customer")
def company_normalise(spark, sf):
    """Customers' names with legal endings, which the key must not hold."""
    key = F.col("c_custkey")
    ending = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (key % 8 + 1).cast("int"))
    name = F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"), ending)
    return table(spark, sf, "customer").select(key.alias("id"), T.company_key(name).alias("company_key"))


@query("document_names", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 3 THEN 'CO_' || o_custkey END AS company, CASE WHEN o_orderkey % 4 < 3 THEN year(o_orderdate)::INT END AS year,
CASE WHEN o_orderkey % 4 = 1 THEN quarter(o_orderdate)::INT END AS quarter, CASE o_orderkey % 4 WHEN 0 THEN '10K' WHEN 1 THEN '10Q' WHEN 2 THEN '8K_dated-' || strftime(o_orderdate, '%Y-%m-%d') END AS form FROM orders""")
def document_names(spark, sf):
    """Names of yearly, quarterly and dated filings, and names that are of no such form."""
    key, year = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    stem = F.concat(F.lit("CO_"), F.col("o_custkey").cast("string"), F.lit("_"), year)
    name = (
        F.when(key % 4 == 0, F.concat(stem, F.lit("_10K")))
        .when(key % 4 == 1, F.concat(stem, F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit("_10Q")))
        .when(key % 4 == 2, F.concat(stem, F.lit("_8K_dated-"), F.date_format("o_orderdate", "yyyy-MM-dd")))
        .otherwise(F.concat(F.lit("notes "), year, F.lit(".txt")))
    )
    return table(spark, sf, "orders").select(key.alias("id"), T.document_name(name).alias("d")).select("id", "d.company", "d.year", "d.quarter", "d.form")


@query("fiscal_calendar", """SELECT o_orderkey, (year(o_orderdate) - CASE WHEN month(o_orderdate) = 1 AND day(o_orderdate) <= 7 THEN 1 ELSE 0 END)::INT AS fiscal_year,
(CASE WHEN month(o_orderdate) = 1 AND day(o_orderdate) <= 7 THEN 12 ELSE month(o_orderdate) END)::INT AS end_month FROM orders""")
def fiscal_calendar(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.fiscal_year(F.col("o_orderdate")).alias("fiscal_year"), T.year_end_month(F.col("o_orderdate")).alias("end_month"))


@query("tokenize_counts", "SELECT tok AS token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+|[0-9]+(?:[.][0-9]+)?')) AS tok FROM documents) GROUP BY tok")
def tokenize_counts(spark, sf):
    tok = table(spark, sf, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    # Counted by document first: a hot token is one row per document after the first aggregate.
    return tok.groupBy("token", "doc_id").count().groupBy("token").agg(F.sum("count").alias("n"), F.count("*").alias("n_docs"))


@query("normalised_text_hash", "SELECT doc_id, sha256(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS norm_sha FROM documents")
def normalised_text_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.normalise(F.col("text")), 256).alias("norm_sha"))


@query("find_all_overlapping", "SELECT doc_id, i::BIGINT AS at FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 2, 0))) AS i FROM documents) WHERE substr(text, (i + 1)::BIGINT, 3) = 'the'")
def find_all_overlapping(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.explode(T.find_all(F.col("text"), "the")).alias("at")).select("doc_id", F.col("at").cast("bigint").alias("at"))


@query("unit_hint", """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e9 WHEN 3 THEN 1e12 END::DOUBLE AS scale, o_orderkey % 7 = 3 OR o_orderkey % 7 = 5 AS is_percent,
CASE WHEN o_orderkey % 3 = 0 THEN 1 + o_orderkey % 4 WHEN o_orderkey % 3 = 1 THEN o_orderkey % 10 END::INT AS decimals FROM orders""")
def unit_hint(spark, sf):
    """Questions that ask for scales, percentages and decimals in several wordings."""
    key = F.col("o_orderkey")
    pick = lambda k, *ways: F.element_at(F.array(*[F.lit(w) for w in ways]), (k + 1).cast("int"))
    scale = pick(key % 5, " in USD thousands", " in millions", " in US dollars billions", ", USD trillion,", " in order")
    percent = pick(key % 7, "", " of percent", "", " in units of percents", " percent", " as a percentage", "")
    places = F.when(key % 3 == 0, F.concat(F.lit(" Round to "), pick(key % 4, "one", "two", "three", "four"), F.lit(" decimal places."))).when(key % 3 == 1, F.concat(F.lit(" Rounded your answer to "), (key % 10).cast("string"), F.lit(" decimals."))).otherwise(F.lit(" To two decimal places."))
    question = F.concat(F.lit("What is the total of order "), key.cast("string"), scale, percent, F.lit("?"), places)
    return table(spark, sf, "orders").select(key.alias("id"), T.unit_hint(question).alias("h")).select("id", "h.scale", "h.is_percent", "h.decimals")


_FIG = "f AS (SELECT o_orderkey AS id, round(o_totalprice, 0) AS number, CASE o_orderkey % 4 WHEN 0 THEN 1e9 WHEN 1 THEN 1e6 ELSE 1.0 END::DOUBLE AS scale, o_orderkey % 4 < 2 AS explicit, o_orderkey % 4 = 3 AS percent FROM orders)"
_READ = "CASE WHEN percent THEN [number / 100 / 1e6] WHEN explicit THEN [number * scale / 1e6] ELSE [number, number / 1e6] END"


def order_figures(spark, sf):
    key = F.col("o_orderkey")
    scale = F.when(key % 4 == 0, 1e9).when(key % 4 == 1, 1e6).otherwise(1.0)
    return table(spark, sf, "orders").select(key.alias("id"), F.round("o_totalprice", 0).alias("number"), scale.alias("scale"), (key % 4 < 2).alias("explicit"), (key % 4 == 3).alias("percent"))


@query("figure_readings", f"WITH {_FIG} SELECT id, unnest({_READ}) AS reading FROM f")
def figure_readings(spark, sf):
    r = N.readings(F.col("number"), F.col("percent"), F.col("scale"), F.col("explicit"), F.lit(False), F.lit(1e6))
    return order_figures(spark, sf).select("id", F.explode(r).alias("reading"))


_FACTORS = (1e3, 1e6, 1e9, 1e-3, 1e-6, 1e-9, 100.0, 0.01)
_NEAR = "abs({x} - 150000) <= greatest(0.1 * 150000, 0.5 * 0.01) * (1 + 1e-9) + 1e-12"


@query("numeric_tolerance_grade", f"""WITH {_FIG}, r AS (SELECT id, unnest({_READ}) AS x FROM f), k AS (SELECT unnest([1.0, 1e3, 1e6, 1e9, 1e-3, 1e-6, 1e-9, 100.0, 0.01]::DOUBLE[]) AS k)
SELECT id, CASE WHEN bool_or(k = 1 AND {_NEAR.format(x='x * k')}) THEN 'correct' WHEN bool_or({_NEAR.format(x='x * k')}) THEN 'unit_error' ELSE 'incorrect' END AS label, bool_or(k = 1 AND {_NEAR.format(x='-x')}) AS sign_mismatch FROM r, k GROUP BY id""")
def numeric_tolerance_grade(spark, sf):
    """Grades of written figures against a gold of 150,000 in millions: tolerance, then wrong units, then wrong."""
    near = lambda x: N.within(x, F.lit(150000.0), 0.1, F.lit(2))
    r = N.readings(F.col("number"), F.col("percent"), F.col("scale"), F.col("explicit"), F.lit(False), F.lit(1e6))
    factors = F.array(*[F.lit(k) for k in _FACTORS])
    label = F.when(F.exists("r", near), "correct").when(F.exists("r", lambda x: F.exists(factors, lambda k: near(x * k))), "unit_error").otherwise("incorrect")
    return order_figures(spark, sf).select("id", r.alias("r")).select("id", label.alias("label"), F.exists("r", lambda x: near(-x)).alias("sign_mismatch"))


#: Parts of answers; an order's key takes one of each kind by its remainders, which have no common divisor.
_OPENINGS = ("", "", "Yes, ", "No, ", "In short: ")
_SUBJECTS = ("the excerpts", "this total", "the data provided", "order {}", "information", "we", "the given figures")
_VERBS = ("do not fully disclose", "can't be determined", "is missing", "was", "are unable to quantify", "never list", "is not available", "do not rise to", "cannot tell", "show", "is insufficient", "does not, as said, state")
_TAILS = ("", " in the filings", " by the details.", "; no relevant data were given", ". There is not enough detailed information", ", no figures. Provided later", " N/A", " here\nunknown", " in any of the materials", " for 5", " of no further detail in this context")
_BARE = ("N/A.", "**none**", "Unknown", "NOT_IN_DOCUMENTS")


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for w in words) + "]"


_AHEAD = "list_slice(w, i + 1, CASE WHEN coalesce(list_position(list_slice(w, i + 1, i + {n}), ','), 0) > 0 THEN i + list_position(list_slice(w, i + 1, i + {n}), ',') - 1 ELSE i + {n} END)"


def _answers_sql() -> str:
    part = lambda words: f"{_list(words)}[(o_orderkey % {len(words)} + 1)::BIGINT]"
    return f"""a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 12 THEN NULL WHEN o_orderkey % 13 = 11 THEN {part(_BARE)} ELSE {part(_OPENINGS)} || replace({part(_SUBJECTS)}, '{{}}', o_orderkey::VARCHAR) || ' ' || {part(_VERBS)} || {part(_TAILS)} END AS answer, o_orderkey % 13 = 12 AND o_orderkey % 2 = 0 AS token FROM orders),
c AS (SELECT id, regexp_extract_all(unnest(regexp_split_to_array({"".join("replace(" for _ in T.CONTRACTED)}lower(answer){"".join(f", '{x.replace(chr(39), chr(39) * 2)}', '{y}')" for x, y in T.CONTRACTED)}, '[.;\\n]')), '[a-z]+|[0-9]+|,') AS w FROM a WHERE answer IS NOT NULL),
d AS (SELECT id, bool_or(len(list_filter(range(1, len(w) + 1), lambda i:
  (w[i] IN ('not', 'never') AND list_has_any({_AHEAD.format(n=T.SAY_REACH)}, {_list(T.SAYING_WORDS)}) AND (list_has_any(w, {_list(T.SOURCE_WORDS)}) OR (list_has_any(w, {_list(T.FACT_WORDS)}) AND list_has_any(w, {_list(T.GIVEN_WORDS)}))))
  OR (w[i] IN ('cannot', 'unable', 'impossible') AND list_has_any({_AHEAD.format(n=T.WORK_REACH)}, {_list(T.WORKING_WORDS)}))
  OR (w[i] = 'insufficient' AND list_has_any({_AHEAD.format(n=T.FACT_REACH)}, {_list(T.FACT_WORDS)}))
  OR (w[i] IN ('unavailable', 'missing') AND (list_has_any(list_slice(w, greatest(i - {T.FACT_REACH}, 1), i - 1), {_list(T.FACT_WORDS)}) OR list_has_any(w, {_list(T.SOURCE_WORDS)}) OR (list_has_any(w, {_list(T.FACT_WORDS)}) AND list_has_any(w, {_list(T.GIVEN_WORDS)}))))
  OR (w[i] = 'no' AND list_has_any({_AHEAD.format(n=T.FACT_REACH)}, {_list(T.FACT_WORDS)}) AND list_has_any(w[i + 1:], {_list(T.GIVEN_WORDS + T.SOURCE_WORDS)})))) > 0) AS declined FROM c GROUP BY id)"""


@query("decline_rules", f"""WITH {_answers_sql()} SELECT a.id, CASE WHEN answer IS NULL THEN CASE WHEN token THEN 'declined' ELSE 'unparsed' END WHEN a.id % 13 = 11 THEN 'declined' WHEN NOT coalesce(declined, false) THEN 'answered'
WHEN regexp_matches(answer, '[0-9]') OR regexp_matches(answer, '^(Yes|No)[^a-zA-Z]') THEN 'partial' ELSE 'declined' END AS status FROM a LEFT JOIN d USING (id)""")
def decline_rules(spark, sf):
    """Answers put together from parts: declining, partly declining, bare and missing ones."""
    key = F.col("o_orderkey")
    part = lambda words: F.get(F.array(*[F.lit(w) for w in words]), (key % len(words)).cast("int"))
    said = F.concat(part(_OPENINGS), F.replace(part(_SUBJECTS), F.lit("{}"), key.cast("string")), F.lit(" "), part(_VERBS), part(_TAILS))
    answer = F.when(key % 13 == 12, F.lit(None)).when(key % 13 == 11, part(_BARE)).otherwise(said)
    token = (key % 13 == 12) & (key % 2 == 0)
    return table(spark, sf, "orders").select(key.alias("id"), T.answer_status(answer, token).alias("status"))


@query("snippets", "SELECT doc_id, CASE WHEN length(s) > 80 THEN rtrim(substr(s, 1, 79)) || '…' ELSE s END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text"), 80).alias("snippet"))


@query("context_blocks", """SELECT conv_id, string_agg('[C' || rn || '] ' || conv_id || ' | ' || role || chr(10) || substr(text, 1, 60), chr(10) || chr(10) ORDER BY rn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 5 GROUP BY conv_id""")
def context_blocks(spark, sf):
    """Labelled excerpts of a context, joined by blank lines in rank order."""
    c = table(spark, sf, "conversations").withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter("rn <= 5")
    block = F.concat(F.lit("[C"), F.col("rn").cast("string"), F.lit("] "), F.col("conv_id").cast("string"), F.lit(" | "), F.col("role"), F.lit("\n"), F.substring("text", 1, 60))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", block.alias("b")))), lambda x: x.b), "\n\n").alias("context"))


@query("canonical_keys", "SELECT event_id, sha256(concat_ws('|', event_type, user_id, event_id)) AS cache_key, substr(sha256(concat_ws('|', event_id)), 1, 12) AS opaque_id FROM events")
def canonical_keys(spark, sf):
    e = table(spark, sf, "events")
    s = lambda c: F.col(c).cast("string")
    return e.select("event_id", T.canonical_key(F.col("event_type"), s("user_id"), s("event_id")).alias("cache_key"), F.substring(T.canonical_key(s("event_id")), 1, 12).alias("opaque_id"))


@query("token_costs", "SELECT conv_id, turn, floor(length(text) / 1.5)::BIGINT + 1 AS token_bound, (((floor(length(text) / 1.5)::BIGINT + 1) * 3.0 + 200 * 15.0) / 1e6 * CASE WHEN turn % 2 = 0 THEN 0.5 ELSE 1 END)::DOUBLE AS cost FROM conversations")
def token_costs(spark, sf):
    bound = N.token_bound(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", bound.alias("token_bound"), N.call_cost(bound, F.lit(200), F.lit(3.0), F.lit(15.0), F.col("turn") % 2 == 0).alias("cost"))


@query("range_options", """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, o_orderkey % 40 AS a, o_orderkey % 40 + 20 AS b FROM orders), v AS (SELECT unnest([5, 20, 30, 55]) AS x),
j AS (SELECT *, CASE k WHEN 0 THEN x >= a WHEN 1 THEN x >= a AND x <= b WHEN 2 THEN x < a WHEN 3 THEN x >= a AND x <= b ELSE x > b END AS inside FROM r, v) SELECT id, (x / 100)::DOUBLE AS v, inside FROM j""")
def range_options(spark, sf):
    """Bounds written in five ways, in percent and as fractions, against four values."""
    key, a, b = F.col("o_orderkey"), F.col("o_orderkey") % 40, F.col("o_orderkey") % 40 + 20
    fraction = lambda x: F.format_string("0.%02d", x)
    text = lambda x: x.cast("string")
    option = (
        F.when(key % 5 == 0, F.concat(F.lit(">= "), fraction(a)))
        .when(key % 5 == 1, F.concat(fraction(a), F.lit(" to "), fraction(b)))
        .when(key % 5 == 2, F.concat(F.lit("< "), text(a), F.lit("%")))
        .when(key % 5 == 3, F.concat(text(a), F.lit("-"), text(b), F.lit("%")))
        .otherwise(F.concat(F.lit("> "), text(b), F.lit("%")))
    )
    options = table(spark, sf, "orders").select(key.alias("id"), T.range_bounds(option).alias("r")).withColumn("v", F.explode(F.array(*[F.lit(v) for v in (0.05, 0.2, 0.3, 0.55)])))
    v, lo, hi = F.col("v"), F.round("r.lo", 12), F.round("r.hi", 12)
    return options.select("id", "v", F.when(F.col("r.strict"), (v > lo) & (v < hi)).otherwise((v >= lo) & (v <= hi)).alias("inside"))


@query("value_formats", """SELECT event_id, CASE WHEN round(value - 50, 2) < 0 THEN '−' ELSE '' END || printf('%.2f', abs(round(value - 50, 2))) AS f, printf('%.1f', round(value, 1)) || '%' AS pct, '$' || printf('%.2f', round(value, 2)) AS usd FROM (SELECT event_id, round(value, 0) AS value FROM events)""")
def value_formats(spark, sf):
    v = F.round("value", 0)
    return table(spark, sf, "events").select("event_id", N.formatted(v - 50, "f", 2).alias("f"), N.formatted(v / 100, "pct", 1).alias("pct"), N.formatted(v, "usd", 2).alias("usd"))


@query("arithmetic_values", "WITH v AS (SELECT count_if(event_type = 'click')::DOUBLE AS n_click, sum(value) AS total, avg(value) AS mean FROM events) SELECT round(n_click, 6) AS n_click, round(total / n_click, 6) AS per_click, round((mean - 1) * 2, 6) AS shifted FROM v")
def arithmetic_values(spark, sf):
    """Named reducers over a table, then arithmetic over their names."""
    named = table(spark, sf, "events").agg(F.count_if(F.col("event_type") == "click").cast("double").alias("n_click"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return named.selectExpr("round(n_click, 6) AS n_click", "round(try_divide(total, n_click), 6) AS per_click", "round((mean - 1) * 2, 6) AS shifted")


@query("corpus_stats", "SELECT lang, count(*) AS n_docs, count(DISTINCT sha256(text)) AS n_distinct, round(avg(n_chars), 6) AS mean_chars, median(n_chars) AS median_chars, sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0b]+')))::BIGINT AS words FROM documents GROUP BY lang")
def corpus_stats(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.countDistinct(F.sha2("text", 256)).alias("n_distinct"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.median("n_chars").alias("median_chars"),
                                    F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0b]+"), F.lit(0)))).alias("words"))
