"""Queries of entity resolution, diffs, model-call caches, budgets, serving metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..registry import literal_rows, query, table
from ..streaming.budget import operations_of_events, replayed_decisions
from .evaluation_tables import TRACES_SQL, sql_draw, traces


def r6(c):
    return F.round(c, 6)


def pieces(rows, wanted, key):
    """(key, piece) of all substrings of ``whole`` whose length some wanted piece has; the lengths of names are few."""
    sizes = wanted.select(F.length("piece").alias("n")).distinct().agg(F.collect_list("n").alias("sizes"))
    fits = F.filter("sizes", lambda n: n <= F.length("whole"))
    cut = F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), F.length("whole") - n + 1), lambda i: F.substring(F.col("whole"), i, n))))
    return rows.crossJoin(F.broadcast(sizes)).select(key, F.explode(F.array_distinct(cut)).alias("piece"))


_NORM = "regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"


@query("entity_resolution_cascade", f"""WITH size AS MATERIALIZED (SELECT count(*) AS n FROM supplier), asked AS MATERIALIZED (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN s_name WHEN 1 THEN s_suppkey::VARCHAR WHEN 2 THEN lower(s_name) || '.' WHEN 3 THEN s_name || ' International' ELSE 'Nobody' || c_custkey END AS q FROM (SELECT c_custkey, c_custkey % n AS own FROM customer, size) JOIN supplier ON s_suppkey = own),
t AS (SELECT s_suppkey AS cik, s_name AS title, s_suppkey::VARCHAR AS ticker, {_NORM.format(x='s_name')} AS k FROM supplier),
a AS (SELECT *, {_NORM.format(x='q')} AS k FROM asked), o AS (SELECT id, 99999 AS cik, 'override' AS method, 0 AS p FROM a WHERE q = 'Nobody4'),
m AS (SELECT * FROM o UNION ALL SELECT a.id, t.cik, 'ticker', 1 FROM a JOIN t ON a.q = t.ticker UNION ALL SELECT a.id, t.cik, 'title_exact', 2 FROM a JOIN t USING (k)
 UNION ALL SELECT p.id, t.cik, 'title_substring', 3 FROM (SELECT DISTINCT id, substr(k, i::BIGINT, n) AS piece FROM (SELECT id, k, n, unnest(range(1, length(k) - n + 2)) AS i FROM a, (SELECT DISTINCT length(k) AS n FROM t WHERE length(k) >= 5) WHERE length(k) >= n)) p JOIN t ON t.k = p.piece
 UNION ALL SELECT a.id, p.cik, 'title_substring', 3 FROM (SELECT DISTINCT cik, substr(k, i::BIGINT, n) AS piece FROM (SELECT cik, k, n, unnest(range(1, length(k) - n + 2)) AS i FROM t, (SELECT DISTINCT length(k) AS n FROM a WHERE length(k) >= 5) WHERE length(k) >= n)) p JOIN a ON a.k = p.piece),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, cik) AS r FROM m) SELECT asked.id, b.cik::BIGINT AS cik, coalesce(b.method, 'unresolved') AS method FROM asked LEFT JOIN b ON b.id = asked.id AND b.r = 1""")
def entity_resolution_cascade(spark, sf):
    """Override, ticker, equal normal form, containment; each step sees only what the ones before left."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cik"), F.col("s_name").alias("title"))
    n = s.count()
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % n).alias("cik")).join(s, "cik")
    kind = F.col("id") % 5
    q = F.when(kind == 0, F.col("title")).when(kind == 1, F.col("cik").cast("string")).when(kind == 2, F.concat(F.lower("title"), F.lit("."))).when(kind == 3, F.concat("title", F.lit(" International"))).otherwise(F.concat(F.lit("Nobody"), F.col("id").cast("string")))
    norm = lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")
    asked = c.select("id", q.alias("q"), norm(q).alias("k"))
    titles = s.select("cik", F.col("cik").cast("string").alias("ticker"), norm("title").alias("tk"))
    steps, left = [], asked
    rules = [("override", literal_rows(spark, [("Nobody4", 99999)], "q string, cik long"), ["q"]), ("ticker", titles.select(F.col("ticker").alias("q"), "cik"), ["q"]), ("title_exact", titles.select(F.col("tk").alias("k"), "cik"), ["k"])]
    for method, known, on in rules:
        found = left.join(known, on).groupBy("id").agg(F.min("cik").alias("cik")).withColumn("method", F.lit(method))
        steps.append(found)
        left = left.join(found.select("id"), "id", "left_anti")
    # Containment both ways as equi-joins: a name holds another if one of its pieces of that name's length equals it.
    long, titled = left.filter(F.length("k") >= 5), titles.filter(F.length("tk") >= 5)
    inside = pieces(long.select("id", F.col("k").alias("whole")), titled.select(F.col("tk").alias("piece")), "id").join(titled.select("cik", F.col("tk").alias("piece")), "piece").select("id", "cik")
    around = pieces(titled.select("cik", F.col("tk").alias("whole")), long.select(F.col("k").alias("piece")), "cik").join(long.select("id", F.col("k").alias("piece")), "piece").select("id", "cik")
    steps.append(inside.unionByName(around).groupBy("id").agg(F.min("cik").alias("cik")).withColumn("method", F.lit("title_substring")))
    every = steps[0]
    for other in steps[1:]:
        every = every.unionByName(other)
    return asked.select("id").join(every, "id", "left").select("id", F.col("cik").cast("bigint").alias("cik"), F.coalesce("method", F.lit("unresolved")).alias("method"))


@query("period_match", """WITH f AS (SELECT o_orderkey, o_custkey, o_orderdate, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders), w AS (SELECT c_custkey, (1995 + c_custkey % 3) * 12 + 1 + c_custkey % 12 AS want FROM customer)
SELECT c_custkey, o_orderkey, (strftime(o_orderdate, '%Y-%m-%d'))::VARCHAR AS filed FROM (SELECT c_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM w JOIN f ON o_custkey = c_custkey AND abs(m - want) <= 1) WHERE r = 1""")
def period_match(spark, sf):
    """A range join on month indexes, within one month: three equi-joinable months instead of a theta join."""
    f = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"))
    want = (F.lit(1995) + F.col("c_custkey") % 3) * 12 + 1 + F.col("c_custkey") % 12
    w = table(spark, sf, "customer").select("c_custkey", F.explode(F.array(want - 1, want, want + 1)).alias("m"))
    hit = f.join(w, (F.col("o_custkey") == F.col("c_custkey")) & (f.m == w.m))
    first = hit.groupBy("c_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("b"))
    return first.select("c_custkey", F.col("b.o_orderkey").alias("o_orderkey"), F.date_format("b.o_orderdate", "yyyy-MM-dd").alias("filed"))


@query("structural_diff", """WITH a AS (SELECT p_partkey AS id, unnest(['size', 'price', 'brand']) AS path, unnest([p_size::VARCHAR, round(p_retailprice, 2)::VARCHAR, p_brand]) AS v, unnest([p_size::DOUBLE, p_retailprice, NULL]) AS num FROM part),
b AS (SELECT id, path, CASE WHEN path = 'brand' AND id % 11 = 0 THEN 'X' ELSE v END AS v, CASE WHEN path = 'price' AND id % 7 = 0 THEN num + 0.001 WHEN path = 'size' AND id % 13 = 0 THEN num + 1 ELSE num END AS num FROM a WHERE NOT (path = 'size' AND id % 17 = 0)),
d AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.path, b.path) AS path, a.id IS NULL AS new, b.id IS NULL AS missing, coalesce(a.num, -1) <> coalesce(b.num, -1) OR (a.num IS NULL AND a.v <> b.v) AS differs, abs(a.num - b.num) <= 0.01 AND a.path = 'price' AS exempt FROM a FULL OUTER JOIN b ON a.id = b.id AND a.path = b.path)
SELECT path, CASE WHEN missing THEN 'missing' WHEN new THEN 'new' WHEN differs AND exempt THEN 'exempt_only' WHEN differs THEN 'different' ELSE 'identical' END AS state, count(*) AS n FROM d GROUP BY ALL""")
def structural_diff(spark, sf):
    """Two nested records compared path by path; small differences of one path are exempt."""
    p = table(spark, sf, "part")
    leaf = lambda name, v, num: F.struct(F.lit(name).alias("path"), v.alias("v"), num.alias("num"))
    none = F.lit(None).cast("double")
    cells = F.array(leaf("size", F.col("p_size").cast("string"), F.col("p_size").cast("double")), leaf("price", F.round("p_retailprice", 2).cast("string"), F.col("p_retailprice").cast("double")), leaf("brand", F.col("p_brand"), none))
    a = p.select(F.col("p_partkey").alias("id"), F.explode(cells).alias("c")).select("id", "c.*")
    i, path = F.col("id"), F.col("path")
    b = a.filter(~((path == "size") & (i % 17 == 0))).select("id", "path", F.when((path == "brand") & (i % 11 == 0), "X").otherwise(F.col("v")).alias("v2"), F.when((path == "price") & (i % 7 == 0), F.col("num") + 0.001).when((path == "size") & (i % 13 == 0), F.col("num") + 1).otherwise(F.col("num")).alias("num2"), F.lit(True).alias("right"))
    j = a.withColumn("left", F.lit(True)).join(b, ["id", "path"], "full_outer")
    differs = ~F.col("num").eqNullSafe(F.col("num2")) | (F.col("num").isNull() & ~F.col("v").eqNullSafe(F.col("v2")))
    state = F.when(F.col("right").isNull(), "missing").when(F.col("left").isNull(), "new").when(differs & (path == "price") & (F.abs(F.col("num") - F.col("num2")) <= 0.01), "exempt_only").when(differs, "different").otherwise("identical")
    return j.groupBy("path", state.alias("state")).agg(F.count("*").alias("n"))


@query("absence_check", r"""WITH p(id, pattern, source) AS (VALUES (1, '(?i)apache license', NULL), (2, '(?i)zebra crossing', NULL), (3, '(?i)mit license', 'src1'), (4, '[0-9]{40}', NULL)) SELECT p.id, count(d.doc_id) AS n_matches, count(d.doc_id) = 0 AS absent FROM p LEFT JOIN documents d ON regexp_matches(d.text, p.pattern) AND (p.source IS NULL OR d.source = p.source) GROUP BY p.id""")
def absence_check(spark, sf):
    """Patterns that must not occur in their scope: one scan, one counter for each pattern."""
    checks = [(1, "(?i)apache license", None), (2, "(?i)zebra crossing", None), (3, "(?i)mit license", "src1"), (4, "[0-9]{40}", None)]
    hit = lambda pattern, source: F.count_if(F.col("text").rlike(pattern) & (F.lit(True) if source is None else F.col("source") == source))
    counted = table(spark, sf, "documents").agg(*[hit(p, s).alias(f"c{i}") for i, p, s in checks])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.col(f"c{i}").alias("n_matches")) for i, _, _ in checks])).alias("r")
    return counted.select(rows).select("r.*").withColumn("absent", F.col("n_matches") == 0)


@query("trace_gold_enrichment", f"WITH {TRACES_SQL} SELECT t.trace_id, b.item_id IS NOT NULL AS has_gold, length(b.text)::BIGINT AS gold_chars, b.item_id % 2 = 0 AS numeric_gold FROM traces t LEFT JOIN benchmark b ON b.item_id = t.question_id AND b.item_id % 5 <> 0")
def trace_gold_enrichment(spark, sf):
    g = table(spark, sf, "benchmark").filter("item_id % 5 <> 0").select(F.col("item_id").alias("question_id"), F.length("text").cast("bigint").alias("gold_chars"), (F.col("item_id") % 2 == 0).alias("numeric_gold"))
    return traces(spark, sf).join(g, "question_id", "left").select("trace_id", F.col("gold_chars").isNotNull().alias("has_gold"), "gold_chars", "numeric_gold")


_KEY = "sha256(concat_ws('|', trace_id, 'answer'))"


@query("replay_cache_join", f"WITH {TRACES_SQL}, c AS (SELECT {_KEY} AS k, n_claims * 10 AS tokens FROM traces WHERE {sql_draw('miss', 'trace_id')} % 25 <> 0) SELECT trace_id, c.k IS NOT NULL AS hit, coalesce(tokens, 0)::BIGINT AS tokens, CASE WHEN c.k IS NULL THEN 'replay_miss' END AS error FROM traces LEFT JOIN c ON c.k = {_KEY}")
def replay_cache_join(spark, sf):
    """Replay by key: hits cost nothing, misses are errors."""
    t = traces(spark, sf).withColumn("k", T.canonical_key(F.col("trace_id"), F.lit("answer")))
    c = t.filter(T.md5_int(F.lit("miss"), F.col("trace_id")) % 25 != 0).select("k", (F.col("n_claims") * 10).alias("tokens"), F.lit(True).alias("in"))
    j = t.select("trace_id", "k").join(c, "k", "left")
    return j.select("trace_id", F.coalesce("in", F.lit(False)).alias("hit"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.when(F.col("in").isNull(), "replay_miss").alias("error"))


@query("budget_running_cap", """WITH r AS (SELECT event_id, event_type, sum(value / 1000) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent, sum(value / 1000) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events)
SELECT event_id, event_type, round(spent, 6) AS spent, round(total, 6) AS total, round(spent, 6) <= 30 AND round(total, 6) <= 100 AS allowed FROM r""")
def budget_running_cap(spark, sf):
    """Running spend of a phase and of all phases against their caps.

    Sums are taken by hour first and carried forward over the hours, so that no task sees
    a whole phase, however many calls it has.
    """
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", (F.col("value") / 1000).alias("cost"), F.date_trunc("hour", "ts").alias("hour"))

    def running(rows, by, name):
        before = Window.partitionBy(*by).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
        carried = rows.groupBy(*by, "hour").agg(F.sum("cost").alias("s")).select(*by, "hour", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("carried"))
        within = Window.partitionBy(*by, "hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("within", F.sum("cost").over(within)).join(carried, [*by, "hour"]).withColumn(name, r6(F.col("within") + F.col("carried"))).drop("within", "carried")

    r = running(running(e, ["event_type"], "spent"), [], "total")
    return r.select("event_id", "event_type", "spent", "total", ((F.col("spent") <= 30) & (F.col("total") <= 100)).alias("allowed"))


@query("budget_reservations")
def budget_reservations(spark, sf):
    """Every call of the event log reserves, settles, releases or lapses under the caps of its project and phase."""
    return replayed_decisions(operations_of_events(table(spark, sf, "events")), project_cap=2.0, phase_cap=0.4)


@query("spend_rollup", "SELECT coalesce(event_type, 'all') AS phase, coalesce(user_id % 3, -1)::BIGINT AS model, count(*) AS calls, round(sum(value / 1000), 4) AS cost FROM events GROUP BY GROUPING SETS ((event_type, user_id % 3), (event_type), (user_id % 3), ())")
def spend_rollup(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("phase"), (F.col("user_id") % 3).alias("model"), (F.col("value") / 1000).alias("cost"))
    g = e.cube("phase", "model").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))
    return g.select(F.coalesce("phase", F.lit("all")).alias("phase"), F.coalesce("model", F.lit(-1)).cast("bigint").alias("model"), "calls", "cost")


@query("resumable_batches", f"WITH {TRACES_SQL}, p AS (SELECT DISTINCT {_KEY} AS k, n_claims + 1 AS worst FROM traces WHERE {sql_draw('have', 'trace_id')} % 3 <> 0), r AS (SELECT k, sum(worst) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) - worst AS before FROM p) SELECT (before // 100)::BIGINT AS batch, count(*) AS n, min(k) AS first_key FROM r GROUP BY 1")
def resumable_batches(spark, sf):
    """Requests that the cache lacks, each key once, cut into batches of bounded worst-case cost.

    The running sum over all keys is taken in two levels (key ranges first), so that no
    single task sees every request.
    """
    t = traces(spark, sf)
    keyed = t.select("trace_id", T.canonical_key(F.col("trace_id"), F.lit("answer")).alias("k"), (F.col("n_claims") + 1).alias("worst"))
    cached = keyed.filter(T.md5_int(F.lit("have"), F.col("trace_id")) % 3 == 0).select("k")
    p = keyed.join(cached, "k", "left_anti").select("k", "worst").distinct().withColumn("part", F.substring("k", 1, 2))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = p.groupBy("part").agg(F.sum("worst").alias("s")).select("part", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("shift"))
    inside = F.coalesce(F.sum("worst").over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = p.withColumn("inside", inside).join(F.broadcast(shift), "part")
    return r.groupBy(F.floor((F.col("inside") + F.col("shift")) / 100).alias("batch")).agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


@query("distinct_requests", f"WITH {TRACES_SQL}, r AS (SELECT {_KEY} AS k, model FROM traces UNION ALL SELECT {_KEY}, model FROM traces WHERE question_id % 2 = 0) SELECT model, count(*) AS asked, count(DISTINCT k) AS sent FROM r GROUP BY model")
def distinct_requests(spark, sf):
    """Equal requests are sent once."""
    t = traces(spark, sf).select("question_id", "model", T.canonical_key(F.col("trace_id"), F.lit("answer")).alias("k"))
    r = t.unionByName(t.filter("question_id % 2 = 0"))
    return r.groupBy("model", "k").count().groupBy("model").agg(F.sum("count").alias("asked"), F.count("*").alias("sent"))


_TAMPERED = ("file", "key", "output", "parse")


@query("replay_verification", f"""WITH {TRACES_SQL}, x AS (SELECT condition, model, prompt, {', '.join(f"{sql_draw('tamper_' + t, 'trace_id')} % 50 <> 0 AS {t}_ok" for t in _TAMPERED)}, {sql_draw('cached', 'trace_id')} % 10 <> 0 AS cached FROM traces)
SELECT condition, model, prompt, count(*) AS n, count_if(file_ok) AS file_ok, count_if(file_ok AND key_ok) AS key_ok, count_if(cached) AS from_cache, count_if(cached AND file_ok AND key_ok AND output_ok) AS output_ok, count_if(parse_ok) AS parse_ok, count_if(file_ok AND key_ok AND parse_ok AND (output_ok OR NOT cached)) AS all_ok FROM x GROUP BY ALL""")
def replay_verification(spark, sf):
    """Four checks of a trace against what it was made from: prompt file, request key, cached output, parsed fields; counted by arm.

    Stored values are recomputed; a trace in fifty has been tampered with at each point.
    """
    drawn = lambda tag, n: T.md5_int(F.lit(tag), F.col("trace_id")) % n == 0
    t = traces(spark, sf).select("trace_id", "condition", "model", "prompt", "question_id", "label")
    text = F.concat(F.lit("# system\nanswer\n# user\n"), F.col("prompt"))
    stored = t.select(
        "*", F.sha2(F.when(drawn("tamper_file", 50), F.concat(text, F.lit(" "))).otherwise(text), 256).alias("file_sha"),
        F.concat(F.lit("ANSWER: "), F.coalesce("label", F.lit("none"))).alias("raw"), F.when(drawn("tamper_parse", 50), F.lit("?")).otherwise(F.coalesce("label", F.lit("none"))).alias("parsed"),
    )
    request = lambda sha, question: T.canonical_key(sha, F.col("model"), question)
    asked = F.when(drawn("tamper_key", 50), F.lit("-1")).otherwise(F.col("question_id").cast("string"))
    stored = stored.withColumn("key", request(F.col("file_sha"), F.concat_ws("/", asked, F.col("trace_id"))))
    now = request(F.sha2(text, 256), F.concat_ws("/", F.col("question_id").cast("string"), F.col("trace_id")))
    # The cache was filled by the requests as they are made now.
    cache = stored.filter(~drawn("cached", 10)).select(now.alias("key"), F.when(drawn("tamper_output", 50), F.concat("raw", F.lit("!"))).otherwise(F.col("raw")).alias("cached"), "trace_id")
    j = stored.join(cache, ["trace_id"], "left").withColumn("hit", F.when(cache["key"] == stored["key"], F.col("cached")))
    file_ok, parse_ok = F.col("file_sha") == F.sha2(text, 256), F.regexp_extract("raw", "^ANSWER: (.*)$", 1) == F.col("parsed")
    key_ok, output_ok, kept = stored["key"] == now, F.coalesce(F.col("hit") == F.col("raw"), F.lit(False)), F.col("cached").isNotNull()
    n = F.count_if
    return j.groupBy("condition", "model", "prompt").agg(F.count("*").alias("n"), n(file_ok).alias("file_ok"), n(key_ok).alias("key_ok"), n(kept).alias("from_cache"), n(output_ok).alias("output_ok"), n(parse_ok).alias("parse_ok"), n(file_ok & key_ok & parse_ok & (output_ok | ~kept)).alias("all_ok"))


@query("dry_run_cost", f"WITH {TRACES_SQL}, m AS (SELECT model, count_if({sql_draw('have', 'trace_id')} % 3 <> 0) AS missing, avg(CASE WHEN {sql_draw('smp', 'trace_id')} % 10 = 0 THEN 100 + n_claims * 40 END) AS sampled FROM traces GROUP BY 1), p(model, price) AS (VALUES ('m1', 3.0), ('m2', 0.8)) SELECT model, missing, round(missing * sampled * price / 1e6, 9)::DOUBLE AS cost FROM m JOIN p USING (model)")
def dry_run_cost(spark, sf):
    """Sampled token counts scaled to the calls that the cache lacks."""
    missing = F.count_if(T.md5_int(F.lit("have"), F.col("trace_id")) % 3 != 0)
    sampled = F.avg(F.when(T.md5_int(F.lit("smp"), F.col("trace_id")) % 10 == 0, 100 + F.col("n_claims") * 40))
    m = traces(spark, sf).groupBy("model").agg(missing.alias("missing"), sampled.alias("s"))
    p = literal_rows(spark, [("m1", 3.0), ("m2", 0.8)], "model string, price double")
    return m.join(F.broadcast(p), "model").select("model", "missing", F.round(F.col("missing") * F.col("s") * F.col("price") / 1e6, 9).alias("cost"))


_BOUNDS = (5, 10, 25, 50, 75, 100, 150, 200, 300, 400, 500, 750, 1000, 2500, 10000)


@query("latency_histogram", f"SELECT event_type, le::INT AS le, count_if(value <= le) AS n FROM events, (SELECT unnest([{', '.join(map(str, _BOUNDS))}]) AS le) GROUP BY ALL")
def latency_histogram(spark, sf):
    """Cumulative buckets: one counter for each bound in a single aggregate."""
    g = table(spark, sf, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{b}") for b in _BOUNDS])
    return g.select("event_type", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{b}").alias("n")) for b in _BOUNDS])).alias("r")).select("event_type", "r.*")


@query("load_levels", "SELECT (user_id % 4)::BIGINT AS users, count(*) AS n, count_if(event_type = 'error') AS errors, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def load_levels(spark, sf):
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    g = table(spark, sf, "events").groupBy((F.col("user_id") % 4).alias("users")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), q.alias("q"))
    return g.select("users", "n", "errors", r6(F.col("q")[0]).alias("p50"), r6(F.col("q")[1]).alias("p95"), r6(F.col("q")[2]).alias("p99"))


@query("distribution_summary", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, round(quantile_cont(value, 0.95), 6) AS p95_linear, round(max(CASE WHEN i = greatest(1, round_even(0.95 * n, 0)) THEN value END), 6) AS p95_bankers, round(max(CASE WHEN i = greatest(1, floor(0.95 * n)) THEN value END), 6) AS p95_floor FROM r GROUP BY 1""")
def distribution_summary(spark, sf):
    """Three definitions of the 95th percentile: linear, index by banker's rounding, index by floor.

    Values are counted by their whole part first; only the parts that hold a wanted index
    are put in order, so that no task orders a whole event type.
    """
    e = table(spark, sf, "events").select("event_type", "event_id", "value", F.floor("value").alias("part"))
    w = Window.partitionBy("event_type")
    parts = e.groupBy("event_type", "part").agg(F.count("*").alias("c")).withColumn("n", F.sum("c").over(w)).withColumn("before", F.sum("c").over(w.orderBy("part")) - F.col("c"))
    index = {"bankers": F.bround(F.lit(0.95) * F.col("n"), 0), "floor": F.floor(F.lit(0.95) * F.col("n"))}
    parts = parts.select("event_type", "part", "n", "c", "before", *[F.greatest(F.lit(1), i).cast("long").alias(k) for k, i in index.items()])
    inside = lambda k: (F.col(k) > F.col("before")) & (F.col(k) <= F.col("before") + F.col("c"))
    ordered = e.join(parts.filter(inside("bankers") | inside("floor")), ["event_type", "part"]).withColumn("i", F.row_number().over(Window.partitionBy("event_type", "part").orderBy("value", "event_id")) + F.col("before"))
    at = lambda k: r6(F.max(F.when(F.col("i") == F.col(k), F.col("value")))).alias(f"p95_{k}")
    linear = e.groupBy("event_type").agg(r6(F.percentile("value", 0.95)).alias("p95_linear"))
    return ordered.groupBy("event_type").agg(F.max("n").alias("n"), at("bankers"), at("floor")).join(linear, "event_type").select("event_type", "n", "p95_linear", "p95_bankers", "p95_floor")


@query("generation_arm_summary", f"WITH {TRACES_SQL} SELECT condition, model, prompt, round(avg((status <> 'unparsed')::INT), 6) AS parse_rate, round(avg((status = 'declined')::INT), 6) AS abstain_rate, round(avg(bit_count(cited_bits)), 6) AS mean_citations, round(avg(confidence), 6) AS mean_confidence, median(confidence) AS median_confidence, sum(n_claims)::BIGINT AS claims FROM traces GROUP BY ALL")
def generation_arm_summary(spark, sf):
    flag = lambda c: r6(F.avg(c.cast("int")))
    return traces(spark, sf).groupBy("condition", "model", "prompt").agg(flag(F.col("status") != "unparsed").alias("parse_rate"), flag(F.col("status") == "declined").alias("abstain_rate"), r6(F.avg(F.bit_count("cited_bits"))).alias("mean_citations"), r6(F.avg("confidence")).alias("mean_confidence"), F.median("confidence").alias("median_confidence"), F.sum("n_claims").alias("claims"))


@query("events_latency_windows", "SELECT event_type, epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS window_start, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS slowest FROM events GROUP BY ALL")
def events_latency_windows(spark, sf):
    """Tumbling windows of an hour; the streaming twin is ``streaming.events.latency_windows``."""
    from ..streaming.events import summarise

    g = summarise(table(spark, sf, "events"))
    return g.select("event_type", F.unix_timestamp("window.start").alias("window_start"), "n", F.round("total", 4).alias("total"), r6("slowest").alias("slowest"))


@query("report_best_cells", f"WITH {TRACES_SQL}, c AS (SELECT condition, model, prompt, avg(coalesce(label = 'correct', false)::INT) AS v FROM traces GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY v DESC, model, prompt) AS r FROM c) SELECT condition, model || ' / ' || prompt AS best, printf('%.1f', round(v * 100, 1)) || '%' AS accuracy FROM k WHERE r = 1")
def report_best_cells(spark, sf):
    """The best cell of every group, formatted for a table."""
    from ..functions.numbers import formatted

    c = traces(spark, sf).groupBy("condition", "model", "prompt").agg(F.avg(F.coalesce(F.col("label") == "correct", F.lit(False)).cast("int")).alias("v"))
    w = Window.partitionBy("condition").orderBy(F.desc("v"), "model", "prompt")
    return c.withColumn("r", F.row_number().over(w)).filter("r = 1").select("condition", F.concat_ws(" / ", "model", "prompt").alias("best"), formatted(F.col("v"), "pct", 1).alias("accuracy"))


@query("context_per_condition", f"WITH {TRACES_SQL}, r AS (SELECT conv_id, turn, length(text) AS score FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM r) SELECT conv_id, string_agg('C' || rank || '=' || turn, ',' ORDER BY rank) AS labels FROM k WHERE rank <= 3 GROUP BY 1")
def context_per_condition(spark, sf):
    """Searched to a fixed depth, cut to k, labelled C1..Ck by rank."""
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")
    k = table(spark, sf, "conversations").withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
    label = F.concat(F.lit("C"), F.col("rank").cast("string"), F.lit("="), F.col("turn").cast("string"))
    return k.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", label.alias("l")))), lambda x: x.l), ",").alias("labels"))


@query("judge_output_validation", """WITH x AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, 1 + o_orderkey % 3 AS n FROM orders) SELECT id, k = 0 AS valid, CASE WHEN k = 1 THEN 0 WHEN k = 5 THEN n + 1 ELSE n END::INT AS n_verdicts FROM x""")
def judge_output_validation(spark, sf):
    """Strict reading of judge output: known verdicts, ids 1..n once, excerpts only for supported claims.

    Outputs of six kinds for every order: sound, no JSON, a repeated id, an unknown
    verdict, excerpts for an unsupported claim, a claim too many.
    """
    k, n = F.col("o_orderkey") % 6, (F.col("o_orderkey") % 3 + 1).cast("int")
    last = lambda i: i == n
    item = lambda i: F.struct(
        F.when((k == 2) & last(i), i + 1).otherwise(i).alias("id"), F.when((k == 3) & last(i), "maybe").when((k == 4) | (i % 2 == 0), "unsupported").otherwise("supported").alias("verdict"),
        F.when((k == 4) | (i % 2 == 1), F.array(F.lit("C1"))).otherwise(F.array().cast("array<string>")).alias("excerpts"),
    )
    raw = F.when(k == 1, "not json").otherwise(F.to_json(F.transform(F.sequence(F.lit(1), n + (k == 5).cast("int")), item)))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), n.alias("n"), raw.alias("raw")).withColumn("v", F.from_json("raw", "array<struct<id: int, verdict: string, excerpts: array<string>>>"))
    kinds = F.array(F.lit("supported"), F.lit("unsupported"), F.lit("contradicted"))
    known = F.forall("v", lambda x: F.array_contains(kinds, x.verdict) & ((x.verdict == "supported") | (F.size(x.excerpts) == 0)))
    complete = F.array_sort(F.transform("v", lambda x: x.id)) == F.sequence(F.lit(1), F.col("n"))
    return rows.select("id", F.coalesce(known & complete, F.lit(False)).alias("valid"), F.when(F.col("raw").startswith("["), F.size("v")).otherwise(0).alias("n_verdicts"))
