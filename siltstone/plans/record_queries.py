"""Queries of scans of records and of the files an analysis leaves behind: indexes, review files, reports, archives, logs."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F

from ..functions import outputs as O
from ..functions import text as T
from ..functions.figures import verdict_schema
from ..registry import query, table
from ..sources import html as H
from ..sources import tables as S
from ..sources.archives import read_archives, write_archives
from .evaluation_tables import TRACES_SQL, traces
from .retrieval_queries import evidence


def mapped(rows, make, schema):
    """Rows through a function of one record (a tuple in, tuples out), in Arrow batches."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(frames):
        for f in frames:
            yield pd.DataFrame([out for row in f.itertuples(index=False, name=None) for out in make(*row)], columns=names)

    return rows.mapInPandas(run, schema)


@query("atom_first_cik", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 3 THEN lpad(s_suppkey::VARCHAR, 10, '0') END AS cik FROM supplier")
def atom_first_cik(spark, sf):
    """Company feeds with and without a name space, and feeds that name no company."""
    key = F.col("s_suppkey").cast("string")
    feed = F.when(F.col("s_suppkey") % 4 == 3, F.lit("<feed><entry/></feed>")).otherwise(
        F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.lit("<feed><company-info><cik>")).otherwise(F.lit("<a:feed><a:company-info><a:CIK x='1'> ")), key, F.lit(" </x></company-info><entry><cik>7</cik></entry></feed>"))
    )
    return table(spark, sf, "supplier").select("s_suppkey", H.first_cik(feed).alias("cik"))


@query("filing_index_exhibits", """SELECT o_custkey, string_agg('d' || o_orderkey || '.htm', ',' ORDER BY o_orderkey) FILTER (WHERE o_orderkey % 4 IN (0, 1)) AS exhibits, count(*) AS n_documents FROM orders GROUP BY 1""")
def filing_index_exhibits(spark, sf):
    """An index page for every customer, a row for each order; the exhibits of one type and its parts."""
    key = F.col("o_orderkey")
    kind = F.when(key % 4 == 0, "EX-13").when(key % 4 == 1, "EX-13.2").when(key % 4 == 2, "EX-131").otherwise("10-K")
    row = F.concat(F.lit("<tr><td>1</td><td>text</td><td><a href='/archives/"), F.col("o_custkey").cast("string"), F.lit("/d"), key.cast("string"), F.lit(".htm'>x</a></td><td>"), kind, F.lit("</td></tr>"))
    rows = table(spark, sf, "orders").select("o_custkey", key.alias("k"), row.alias("row"))
    pages = rows.groupBy("o_custkey").agg(F.concat(F.lit("<table><tr><th>Seq</th></tr>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x.row), ""), F.lit("</table>")).alias("html"))

    def read(custkey, page):
        index = H.filing_index(page)
        yield custkey, ",".join(H.exhibits(index, "EX-13")) or None, len(index)

    return mapped(pages, read, "o_custkey long, exhibits string, n_documents long")


@query("trace_round_trip", f"WITH {TRACES_SQL} SELECT condition, model, prompt, count(*) AS n, count(label) AS labelled, sum(question_id)::BIGINT AS questions FROM traces GROUP BY ALL")
def trace_round_trip(spark, sf):
    """Traces written by arm and read back."""
    folder = S.shared_folder(spark, "traces")
    S.write_traces(traces(spark, sf), folder)
    return spark.read.parquet(folder).groupBy("condition", "model", "prompt").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum("question_id").alias("questions"))


@query("request_log", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(event_id)::BIGINT AS ids, round(sum(value), 4) AS total, max(user_id) AS last_user FROM events GROUP BY 1")
def request_log(spark, sf):
    """Requests appended as JSON lines to a folder for each day, read back and summed up."""
    folder = S.shared_folder(spark, "requests")
    e = table(spark, sf, "events")
    lines = e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("value"))
    lines.write.mode("overwrite").partitionBy("day").text(folder)
    back = spark.read.schema("value string, day string").option("basePath", folder).text(folder).select("day", F.from_json("value", "event_id long, user_id long, event_type string, value double").alias("r"))
    return back.groupBy("day").agg(F.count("*").alias("n"), F.sum("r.event_id").alias("ids"), F.round(F.sum("r.value"), 4).alias("total"), F.max("r.user_id").alias("last_user"))


@query("release_archive", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS restored_sha FROM documents")
def release_archive(spark, sf):
    """Texts written to archives of bounded size, and read back against the released checksums."""
    folder = S.shared_folder(spark, "release")
    write_archives(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), folder)
    back = read_archives(spark, folder)
    return back.select(F.col("id").alias("doc_id"), F.octet_length("content").cast("bigint").alias("n_bytes"), F.sha2("content", 256).alias("restored_sha"))



@query("nested_records", """SELECT p_partkey, p_size::DOUBLE AS size, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS price, 'deep.0.ci95_hi,deep.0.ci95_lo,deep.0.n,size' || CASE WHEN p_partkey % 3 = 0 THEN ',x.price' ELSE '' END AS keys FROM part""")
def nested_records(spark, sf):
    """Values at dotted paths and the flattened keys of nested records."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_retailprice")

    def read(key, size, price):
        record = {"size": size, "flag": True, "deep": [{"ci95": [1.0, 2.0], "n": 3, "bad": float("inf")}], "x": {"price": price} if key % 3 == 0 else {}}
        yield key, O.lookup(record, "size"), O.lookup(record, "x.price"), ",".join(sorted(O.flatten(record)))

    return mapped(p, read, "p_partkey long, size double, price double, keys string")


@query("review_files", """SELECT conv_id, turn, CASE WHEN turn % 4 IN (0, 1) THEN CASE turn % 2 WHEN 0 THEN 'agree' ELSE 'disagree' END END AS decision, CASE turn % 4 WHEN 2 THEN 'none marked' WHEN 3 THEN 'several marked' END AS problem, 'turn ' || turn AS comment FROM conversations""")
def review_files(spark, sf):
    """A review file for every conversation, an item for each turn: the marked option, the comment, what is wrong."""
    turn = F.col("turn")
    marks = F.when(turn % 4 == 0, "[x] agree [ ] disagree").when(turn % 4 == 1, "[ ] agree [X] disagree").when(turn % 4 == 2, "[ ] agree [ ] disagree").otherwise("[x] agree [x] disagree")
    item = F.concat(F.lit("## "), turn.cast("string"), F.lit("\n"), marks, F.lit("\ncomment: turn "), turn.cast("string"), F.lit("\n"))
    files = table(spark, sf, "conversations").groupBy("conv_id").agg(F.concat(F.lit("# review\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x.i), "")).alias("file"))

    def read(conv_id, file):
        for r in O.parse_review(file):
            yield conv_id, int(r["item"]), r["decision"], r["problem"], r["comment"]

    return mapped(files, read, "conv_id long, turn long, decision string, problem string, comment string")


@query("rendered_reports", """SELECT c_custkey, c_name || ' owes ' || printf('%.2f', round(c_acctbal, 2)) || ' of 100' AS report, '100' AS literals, c_custkey % 5 = 0 AS failed FROM customer""")
def rendered_reports(spark, sf):
    """Reports rendered from placeholders, the numbers typed into the template, and templates with an unknown placeholder."""
    # As texts: pandas would make floats of whole numbers among nulls, and NaN of a null balance.
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("double").cast("string"))

    def render(key, name, balance):
        template = "{{name}} owes {{balance}} of 100"
        values, failed = {"name": name, "balance": balance and O.two_decimals(float(balance))}, None
        if key is not None:
            try:
                O.render(template + "{{unknown}}" * (int(key) % 5 == 0), values)
                failed = False
            except KeyError:
                failed = True
        yield key, None if None in values.values() else O.render(template, values), ",".join(O.typed_literals(template)), failed

    made = mapped(c, render, "c_custkey string, report string, literals string, failed boolean")
    return made.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("judge_requests", f"WITH {TRACES_SQL} SELECT trace_id, 1 + bit_count(cited_bits)::INT AS n_labels, sha256('{{\"labels\":' || (1 + bit_count(cited_bits)) || ',\"trace\":\"' || trace_id || '\"}}') AS request_sha FROM traces")
def judge_requests(spark, sf):
    """The schema of a judge's verdicts allows the labels of the context only; requests are keyed by their canonical JSON."""
    t = traces(spark, sf).select("trace_id", (F.bit_count("cited_bits") + 1).cast("int").alias("k"))

    def ask(trace_id, k):
        schema = verdict_schema([f"C{i + 1}" for i in range(k)])
        allowed = schema["items"]["properties"]["excerpts"]["items"]["enum"]
        body = json.dumps({"trace": trace_id, "labels": len(allowed)}, sort_keys=True, separators=(",", ":"))
        yield trace_id, len(allowed), hashlib.sha256(body.encode()).hexdigest()

    return mapped(t, ask, "trace_id string, n_labels int, request_sha string")


@query("evidence_original_offsets", """WITH b AS (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS needle FROM benchmark), d AS (SELECT doc_id, text, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS hay FROM documents),
p AS (SELECT item_id, doc_id, text, needle, instr(hay, needle) AS spot FROM b JOIN d ON contains(hay, needle)), m AS (SELECT *, list_filter(range(1, length(text) + 1), lambda i: regexp_matches(lower(substr(text, i::BIGINT, 1)), '^[a-z0-9]$')) AS kept FROM p)
SELECT item_id, doc_id, (kept[spot] - 1)::BIGINT AS char_start, kept[spot + length(needle) - 1]::BIGINT AS char_end, sha256(substr(text, kept[spot]::BIGINT, (kept[spot + length(needle) - 1] - kept[spot] + 1)::BIGINT)) AS span_sha FROM m""")
def evidence_original_offsets(spark, sf):
    """Where evidence aligned in normalised text stands in the original: offsets of the first and the last character that the normal form keeps."""
    found = evidence(table(spark, sf, "documents"), table(spark, sf, "benchmark"), T.normalise)
    p = found.select("item_id", "doc_id", "text", T.normalise(F.col("item_text")).alias("needle"), T.normalise(F.col("text")).alias("hay")).filter(F.contains("hay", "needle"))
    at, size = F.expr("locate(needle, hay)"), F.length("needle")
    m = p.withColumn("kept", T.kept_offsets(F.col("text")))
    start, end = F.get("kept", at - 1), F.get("kept", at + size - 2) + 1
    return m.select("item_id", "doc_id", start.cast("bigint").alias("char_start"), end.cast("bigint").alias("char_end"), F.sha2(F.substring(F.col("text"), start + 1, end - start), 256).alias("span_sha"))
