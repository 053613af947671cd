"""Queries of evaluation: grades, groundedness, citations, calibration, agreement, resampling, selection."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..functions.text import md5_int
from ..operators import agreement as A
from ..operators import resampling as S
from ..registry import PLANS, SQL, query, table
from ..sources.tables import kept
from .draws import RESAMPLES, draw_sql
from .evaluation_tables import ARM, CLAIMS_RUNS_SQL, CLAIMS_SQL, GROUNDED_SQL, RUNS_SQL, TRACES_SQL, claims, grounded, sql_draw, traces
from .retrieval_queries import _METRICS, BM25, CHUNKS, GOLD, RELEVANT, bm25_metrics

CORRECT = "CASE WHEN label = 'correct' THEN true WHEN label IN ('incorrect', 'unit_error', 'partially_correct') THEN false END"


def r6(c):
    return F.round(c, 6)


def share(flag, of):
    """Rows with the flag over rows of a kind; null without any."""
    return r6(F.try_divide(F.count_if(flag & of), F.count_if(of)))


@query("final_status", f"WITH {TRACES_SQL} SELECT trace_id, CASE WHEN status = 'unparsed' THEN 'unparsed' WHEN question_id % 5 = 0 AND confidence IS NOT NULL THEN CASE WHEN confidence < 20 THEN 'declined' ELSE 'answered' END ELSE status END AS final, CASE WHEN status = 'unparsed' THEN 'output' WHEN question_id % 5 = 0 AND confidence IS NOT NULL THEN 'judge' ELSE 'rule' END AS source FROM traces")
def final_status(spark, sf):
    """Facts of the output first, then the judge's type, then the rule."""
    output = F.when(F.col("status") == "unparsed", "unparsed")
    judge = F.when((F.col("question_id") % 5 == 0) & F.col("confidence").isNotNull(), F.when(F.col("confidence") < 20, "declined").otherwise("answered"))
    source = F.when(output.isNotNull(), "output").when(judge.isNotNull(), "judge").otherwise("rule")
    return traces(spark, sf).select("trace_id", F.coalesce(output, judge, F.col("status")).alias("final"), source.alias("source"))


@query("answerability", f"WITH {TRACES_SQL} SELECT trace_id, CASE WHEN condition = 'oracle' THEN 'answerable' WHEN NOT in_corpus THEN CASE WHEN question_id % 7 = 0 THEN 'answerable_elsewhere' ELSE 'unanswerable' END WHEN confidence IS NULL THEN 'no_gold' WHEN confidence > 50 THEN 'evidence_present' ELSE 'evidence_absent' END AS class FROM traces")
def answerability(spark, sf):
    recall = (F.col("confidence") > 50).cast("int")
    cls = F.when(F.col("condition") == "oracle", "answerable").when(~F.col("in_corpus"), F.when(F.col("question_id") % 7 == 0, "answerable_elsewhere").otherwise("unanswerable")).when(recall.isNull(), "no_gold").when(recall > 0, "evidence_present").otherwise("evidence_absent")
    return traces(spark, sf).select("trace_id", cls.alias("class"))


@query("quadrants", f"WITH {CLAIMS_SQL}, {GROUNDED_SQL} SELECT CASE WHEN c AND g THEN 'correct_grounded' WHEN c THEN 'correct_not_grounded' WHEN g THEN 'not_correct_grounded' ELSE 'not_correct_not_grounded' END AS quadrant, prompt, count(*) AS n FROM (SELECT prompt, {CORRECT} AS c, fully_grounded AS g FROM traces JOIN grounded USING (trace_id)) WHERE c IS NOT NULL AND g IS NOT NULL GROUP BY ALL")
def quadrants(spark, sf):
    t = traces(spark, sf).join(grounded(claims(spark, sf)), "trace_id")
    return t.select("prompt", N.quadrant(N.is_correct(F.col("label")), F.col("fully_grounded")).alias("quadrant")).filter("quadrant IS NOT NULL").groupBy("quadrant", "prompt").agg(F.count("*").alias("n"))


@query("groundedness_score", f"WITH {CLAIMS_SQL}, {GROUNDED_SQL} SELECT * REPLACE (round(groundedness, 6) AS groundedness) FROM grounded")
def groundedness_score(spark, sf):
    return grounded(claims(spark, sf)).withColumn("groundedness", r6("groundedness"))


_BITS = "bit_count((cited_bits & {x})::BIGINT)"


@query("citation_metrics", f"""WITH {CLAIMS_SQL}, s AS (SELECT trace_id, max(cited_bits) AS cited, bit_or(CASE WHEN kind = 'document' AND judge = 'supported' THEN support_bits ELSE 0 END) AS support, count_if(kind = 'document' AND judge = 'supported') AS n_supported,
count_if(kind = 'document' AND judge = 'supported' AND (cited_bits & support_bits) <> 0) AS n_cited FROM claims GROUP BY 1)
SELECT trace_id, round(bit_count(cited & support) / nullif(bit_count(cited), 0), 6) AS citation_precision, round(n_cited / nullif(n_supported, 0), 6) AS citation_recall FROM s""")
def citation_metrics(spark, sf):
    """Cited excerpts that support a document claim; supported document claims with a cited supporter."""
    ok = (F.col("kind") == "document") & (F.col("judge") == "supported")
    s = claims(spark, sf).groupBy("trace_id").agg(F.max("cited_bits").alias("cited"), F.bit_or(F.when(ok, F.col("support_bits")).otherwise(F.lit(0))).alias("support"), F.count_if(ok).alias("n"), F.count_if(ok & (F.col("cited_bits").bitwiseAND(F.col("support_bits")) != 0)).alias("hit"))
    return s.select("trace_id", r6(F.try_divide(F.bit_count(F.col("cited").bitwiseAND(F.col("support"))), F.bit_count("cited"))).alias("citation_precision"), r6(F.try_divide(F.col("hit"), F.col("n"))).alias("citation_recall"))


@query("calibration_ece", f"""WITH {TRACES_SQL}, p AS (SELECT condition, least(confidence * 10 // 100, 9) AS bin, confidence, ({CORRECT})::INT AS ok FROM traces WHERE confidence IS NOT NULL AND {CORRECT} IS NOT NULL),
b AS (SELECT condition, bin, count(*) AS n, avg(confidence) AS conf, avg(ok) AS rate FROM p GROUP BY ALL), e AS (SELECT condition, sum(n * abs(rate - conf / 100)) / sum(n) AS ece FROM b GROUP BY 1),
g AS (SELECT c.condition, u.bin FROM (SELECT DISTINCT condition FROM p) c, (SELECT unnest(range(10)) AS bin) u)
SELECT g.condition, g.bin, coalesce(n, 0) AS n, round(conf, 6) AS mean_confidence, round(rate, 6) AS observed, round(ece, 6) AS ece FROM g LEFT JOIN b USING (condition, bin) JOIN e USING (condition)""")
def calibration_ece(spark, sf):
    """Ten equal bins, the top one closed, empty ones kept."""
    ok = N.is_correct(F.col("label"))
    p = traces(spark, sf).filter(F.col("confidence").isNotNull() & ok.isNotNull()).select("condition", F.least(F.floor(F.col("confidence") * 10 / 100), F.lit(9)).cast("bigint").alias("bin"), "confidence", ok.cast("int").alias("ok"))
    b = p.groupBy("condition", "bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("conf"), F.avg("ok").alias("rate"))
    e = b.groupBy("condition").agg((F.sum(F.col("n") * F.abs(F.col("rate") - F.col("conf") / 100)) / F.sum("n")).alias("ece"))
    grid = e.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))))
    return grid.join(b, ["condition", "bin"], "left").select("condition", "bin", F.coalesce("n", F.lit(0)).alias("n"), r6("conf").alias("mean_confidence"), r6("rate").alias("observed"), r6("ece").alias("ece"))


_SUMS = f"""count(*) AS n, count_if(status = 'answered') AS n_answered, count_if(status = 'declined') AS n_declined, count_if(label IS NULL) AS n_judge_errors, round(count_if(label = 'correct') / nullif(count(label), 0), 6) AS accuracy_graded,
round(count_if(label = 'correct') / count(*), 6) AS accuracy_all, round(sum(n_supported) / nullif(sum(n_document), 0), 6) AS pooled_groundedness, round(avg(groundedness), 6) AS mean_groundedness, round(avg(confidence), 6) AS mean_confidence"""


@query("arm_aggregate_grouping_sets", f"WITH {CLAIMS_SQL}, {GROUNDED_SQL} SELECT coalesce(condition, 'all') AS condition, coalesce(model, 'all') AS model, coalesce(prompt, 'all') AS prompt, {_SUMS} FROM traces LEFT JOIN grounded USING (trace_id) GROUP BY GROUPING SETS ((condition, model, prompt), (condition, model), (condition), ())")
def arm_aggregate_grouping_sets(spark, sf):
    """Arms and their pools in one pass."""
    t = traces(spark, sf).join(grounded(claims(spark, sf)).select("trace_id", "n_supported", "n_document", "groundedness"), "trace_id", "left")
    correct = F.count_if(F.col("label") == "correct")
    g = t.groupingSets([["condition", "model", "prompt"], ["condition", "model"], ["condition"], []], "condition", "model", "prompt").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "answered").alias("n_answered"), F.count_if(F.col("status") == "declined").alias("n_declined"), F.count_if(F.col("label").isNull()).alias("n_judge_errors"),
        r6(F.try_divide(correct, F.count("label"))).alias("accuracy_graded"), r6(correct / F.count("*")).alias("accuracy_all"), r6(F.try_divide(F.sum("n_supported"), F.sum("n_document"))).alias("pooled_groundedness"), r6(F.avg("groundedness")).alias("mean_groundedness"), r6(F.avg("confidence")).alias("mean_confidence"),
    )
    return g.fillna("all", ["condition", "model", "prompt"])


def _kappa_sql(source: str, a: str, b: str, by: str = "") -> str:
    sel, on = (f"{by}, " if by else ""), (f"USING ({by})" if by else "ON true")
    group = f"GROUP BY {by}" if by else ""
    return f"""t AS (SELECT {sel}count(*) AS n, avg(({a} = {b})::INT) AS po FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL {group}), ma AS (SELECT {sel}{a} AS l, count(*) AS c FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
mb AS (SELECT {sel}{b} AS l, count(*) AS c FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL), pe AS (SELECT {'ma.' + by + ',' if by else ''} sum(ma.c * mb.c) AS s FROM ma JOIN mb ON ma.l = mb.l {'AND ma.' + by + ' = mb.' + by if by else ''} {'GROUP BY ma.' + by if by else ''}),
k AS (SELECT {sel}n, po AS agreement, CASE WHEN coalesce(s, 0) / (n * n) < 1 THEN (po - coalesce(s, 0) / (n * n)) / (1 - coalesce(s, 0) / (n * n)) END AS kappa FROM t LEFT JOIN pe {on})"""


@query("cohen_kappa_labels", f"WITH {_kappa_sql('labels', 'quality', 'toxic')} SELECT n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa FROM k")
def cohen_kappa_labels(spark, sf):
    return A.cohen_kappa(table(spark, sf, "labels"), "quality", "toxic").select("n", r6("agreement").alias("agreement"), r6("kappa").alias("kappa"))


@query("rater_pairs_by_kind", f"WITH {CLAIMS_SQL}, {_kappa_sql('claims', 'judge', 'human', 'kind')} SELECT kind, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa FROM k")
def rater_pairs_by_kind(spark, sf):
    return A.cohen_kappa(claims(spark, sf), "judge", "human", ["kind"]).select("kind", "n", r6("agreement").alias("agreement"), r6("kappa").alias("kappa"))


_PAIRS = "pairs AS (SELECT 'judge_second' AS pair, judge AS a, second AS b FROM claims UNION ALL SELECT 'judge_retest', judge, retest FROM claims UNION ALL SELECT 'judge_human', judge, human FROM claims UNION ALL SELECT 'second_human', second, human FROM claims)"


@query("agreement_by_pair", f"WITH {CLAIMS_SQL}, {_PAIRS}, {_kappa_sql('pairs', 'a', 'b', 'pair')} SELECT pair, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa FROM k")
def agreement_by_pair(spark, sf):
    """All rater pairs from one scan: the pairs are unpivoted, then grouped."""
    raters = [("judge", "second"), ("judge", "retest"), ("judge", "human"), ("second", "human")]
    pair = F.explode(F.array(*[F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in raters])).alias("p")
    return A.cohen_kappa(claims(spark, sf).select(pair).select("p.*"), "a", "b", ["pair"]).select("pair", "n", r6("agreement").alias("agreement"), r6("kappa").alias("kappa"))


@query("answer_level_agreement", f"WITH {CLAIMS_SQL}, w AS (SELECT trace_id, bool_and(judge = 'supported') AS judge, bool_and(human = 'supported') AS human FROM claims WHERE kind = 'document' GROUP BY 1) SELECT count(*) AS n, round(avg((judge = human)::INT), 6) AS agreement, count_if(judge AND NOT human) AS judge_only, count_if(human AND NOT judge) AS human_only FROM w")
def answer_level_agreement(spark, sf):
    w = claims(spark, sf).filter("kind = 'document'").groupBy("trace_id").agg(F.bool_and(F.col("judge") == "supported").alias("j"), F.bool_and(F.col("human") == "supported").alias("h"))
    return w.agg(F.count("*").alias("n"), r6(F.avg((F.col("j") == F.col("h")).cast("int"))).alias("agreement"), F.count_if(F.col("j") & ~F.col("h")).alias("judge_only"), F.count_if(F.col("h") & ~F.col("j")).alias("human_only"))


@query("confusion_matrix", f"WITH {CLAIMS_SQL}, l(label) AS (VALUES ('supported'), ('unsupported'), ('contradicted')) SELECT a.label AS judge, b.label AS human, (SELECT count(*) FROM claims WHERE judge = a.label AND human = b.label) AS n FROM l a, l b")
def confusion_matrix(spark, sf):
    labels = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("supported", "unsupported", "contradicted")])).alias("label"))
    return A.confusion(claims(spark, sf), "judge", "human", labels)


_DETECTED = f"""det AS (SELECT condition, CASE WHEN status IN ('answered', 'partial', 'declined') THEN status END AS rule, CASE WHEN status = 'unparsed' THEN NULL WHEN {sql_draw('jt', 'trace_id')} % 100 < 12 THEN CASE status WHEN 'answered' THEN 'partial' WHEN 'partial' THEN 'declined' ELSE 'answered' END ELSE status END AS judged FROM traces),
views AS (SELECT 'three_way/' || condition AS view, rule, judged FROM det UNION ALL SELECT 'declined_or_not/' || condition, (rule = 'declined')::VARCHAR, (judged = 'declined')::VARCHAR FROM det)"""


@query("detector_agreement", f"WITH {TRACES_SQL}, {_DETECTED}, {_kappa_sql('views', 'rule', 'judged', 'view')} SELECT view, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa FROM k")
def detector_agreement(spark, sf):
    """The rule's type of an answer against the judge's, in three classes and as declined or not."""
    status = F.col("status")
    other = F.when(status == "answered", "partial").when(status == "partial", "declined").otherwise("answered")
    judged = F.when(status != "unparsed", F.when(md5_int(F.lit("jt"), F.col("trace_id")) % 100 < 12, other).otherwise(status))
    d = traces(spark, sf).select("condition", F.when(status != "unparsed", status).alias("rule"), judged.alias("judged"))
    view = lambda name, a, b: F.struct(F.concat(F.lit(name + "/"), F.col("condition")).alias("view"), a.alias("rule"), b.alias("judged"))
    two = lambda c: (F.col(c) == "declined").cast("string")
    both = d.select(F.explode(F.array(view("three_way", F.col("rule"), F.col("judged")), view("declined_or_not", two("rule"), two("judged")))).alias("v")).select("v.*")
    return A.cohen_kappa(both, "rule", "judged", ["view"]).select("view", "n", r6("agreement").alias("agreement"), r6("kappa").alias("kappa"))


@query("grader_crosscheck", f"WITH {TRACES_SQL}, g AS (SELECT *, CASE WHEN {sql_draw('num', 'trace_id')} % 10 < 8 THEN label ELSE 'incorrect' END AS numeric_label FROM traces WHERE status = 'answered') SELECT coalesce(label, 'none') AS judge, coalesce(numeric_label, 'none') AS numeric_label, count(*) AS n, count_if(coalesce(label = 'unit_error', false)) AS unit_flags FROM g GROUP BY 1, 2")
def grader_crosscheck(spark, sf):
    t = traces(spark, sf).filter("status = 'answered'")
    other = F.when(md5_int(F.lit("num"), F.col("trace_id")) % 10 < 8, F.col("label")).otherwise("incorrect")
    none = lambda c: F.coalesce(c, F.lit("none"))
    return t.select(none(F.col("label")).alias("judge"), none(other).alias("numeric_label"), "label").groupBy("judge", "numeric_label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "unit_error").alias("unit_flags"))


@query("judge_error_histogram", f"WITH {TRACES_SQL}, e AS (SELECT condition, unnest(string_split(CASE WHEN label IS NULL THEN 'grade:truncated;verify:missing' WHEN status = 'unparsed' THEN 'parse:invalid' END, ';')) AS issue FROM traces) SELECT condition, split_part(issue, ':', 1) AS stage, split_part(issue, ':', 2) AS reason, count(*) AS n FROM e GROUP BY ALL")
def judge_error_histogram(spark, sf):
    issues = F.when(F.col("label").isNull(), F.lit("grade:truncated;verify:missing")).when(F.col("status") == "unparsed", F.lit("parse:invalid"))
    e = traces(spark, sf).select("condition", F.explode(F.split(issues, ";")).alias("i"))
    return e.groupBy("condition", F.split_part("i", F.lit(":"), F.lit(1)).alias("stage"), F.split_part("i", F.lit(":"), F.lit(2)).alias("reason")).agg(F.count("*").alias("n"))


@query("spearman_midrank", "WITH e AS (SELECT event_type, value AS x, user_id AS y FROM events), r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY x) + (count(*) OVER (PARTITION BY event_type, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY event_type ORDER BY y) + (count(*) OVER (PARTITION BY event_type, y) - 1) / 2.0 AS ry FROM e) SELECT event_type, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1")
def spearman_midrank(spark, sf):
    """Pearson of mid-ranks; ranks come from counts by value, so hot values cost one row."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("value").alias("x"), F.col("user_id").alias("y"))
    ranked = A.mid_ranks(A.mid_ranks(e, "x", ["event_type"], "rx"), "y", ["event_type"], "ry")
    return ranked.groupBy("event_type").agg(F.count("*").alias("n"), r6(N.guarded_corr(F.col("rx"), F.col("ry"))).alias("rho"))


@query("mid_ranks", "SELECT turn, n, round(before + (n + 1) / 2.0, 6)::DOUBLE AS mid_rank FROM (SELECT turn, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations GROUP BY turn)")
def mid_ranks(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    return A.mid_ranks(c, "turn", name="mid_rank").groupBy("turn").agg(F.count("*").alias("n"), F.round(F.first("mid_rank"), 6).cast("double").alias("mid_rank"))


@query("pearson_guarded", f"WITH {TRACES_SQL} SELECT model, prompt, CASE WHEN count(confidence) >= 3 AND stddev_pop(CASE WHEN confidence IS NOT NULL THEN n_claims END) > 0 AND stddev_pop(confidence) > 0 THEN round(corr(confidence, n_claims), 6) END AS r FROM traces GROUP BY ALL")
def pearson_guarded(spark, sf):
    return traces(spark, sf).groupBy("model", "prompt").agg(r6(N.guarded_corr(F.col("confidence"), F.col("n_claims"))).alias("r"))


@query("jaccard_flags", "SELECT doc_id % 4 AS part, round(count_if(quality = 0 AND toxic = 1) / nullif(count_if(quality = 0 OR toxic = 1), 0), 6) AS jaccard FROM labels GROUP BY 1")
def jaccard_flags(spark, sf):
    return table(spark, sf, "labels").groupBy((F.col("doc_id") % 4).alias("part")).agg(r6(A.jaccard(F.col("quality") == 0, F.col("toxic") == 1)).alias("jaccard"))


@query("dominant_share", f"WITH {TRACES_SQL} SELECT condition, model, round(max(c) / sum(c), 6) AS share FROM (SELECT condition, model, label, count(*) AS c FROM traces WHERE label IS NOT NULL GROUP BY ALL) GROUP BY 1, 2")
def dominant_share(spark, sf):
    return traces(spark, sf).filter("label IS NOT NULL").groupBy("condition", "model", "label").count().groupBy("condition", "model").agg(r6(F.max("count") / F.sum("count")).alias("share"))


_RUN = f"WITH {RUNS_SQL}, m AS (SELECT run, condition, avg((label = 'correct')::INT) AS v FROM traces WHERE label IS NOT NULL GROUP BY ALL)"


@query("run_spread", f"{_RUN} SELECT condition, CASE WHEN count(v) = count(*) THEN round(avg(v), 6) END AS mean, CASE WHEN count(v) = count(*) THEN round(stddev_samp(v), 6) END AS std, round(min(v), 6) AS low, round(max(v), 6) AS high FROM m GROUP BY 1")
def run_spread(spark, sf):
    m = traces(spark, sf, 3).filter("label IS NOT NULL").groupBy("run", "condition").agg(F.avg((F.col("label") == "correct").cast("int")).alias("v"))
    whole = F.count("v") == F.count("*")
    return m.groupBy("condition").agg(F.when(whole, r6(F.avg("v"))).alias("mean"), F.when(whole, r6(F.stddev_samp("v"))).alias("std"), r6(F.min("v")).alias("low"), r6(F.max("v")).alias("high"))


@query("outcome_stability", f"WITH {RUNS_SQL}, q AS (SELECT condition, model, prompt, question_id, count(DISTINCT label) AS d, bool_and(label = 'correct') AS always, bool_or(label = 'correct') AS ever FROM traces GROUP BY ALL HAVING count(label) = 3) SELECT condition, model, prompt, count(*) AS n, count_if(d > 1) AS changed, count_if(always) AS always, count_if(ever) AS ever FROM q GROUP BY ALL")
def outcome_stability(spark, sf):
    ok = F.col("label") == "correct"
    q = traces(spark, sf, 3).groupBy(*ARM, "question_id").agg(F.count("label").alias("n"), F.countDistinct("label").alias("d"), F.bool_and(ok).alias("always"), F.bool_or(ok).alias("ever")).filter("n = 3")
    return q.groupBy(*ARM).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 1).alias("changed"), F.count_if("always").alias("always"), F.count_if("ever").alias("ever"))


@query("cluster_bootstrap_ci", f"WITH {CLAIMS_SQL}, {GROUNDED_SQL}, u AS (SELECT condition, question_id, sum(groundedness) AS total, count(groundedness) AS weight FROM traces JOIN grounded USING (trace_id) GROUP BY ALL), {draw_sql(7, 'u', 'condition', 'question_id')} SELECT condition, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi, count_if(mean IS NULL) AS n_undefined FROM rep GROUP BY 1")
def cluster_bootstrap_ci(spark, sf):
    """Questions are drawn with all their traces; each is its sum and count before the draws."""
    t = traces(spark, sf).join(grounded(claims(spark, sf)).select("trace_id", "groundedness"), "trace_id")
    u = t.groupBy("condition", "question_id").agg(F.sum("groundedness").alias("total"), F.count("groundedness").alias("weight"))
    return S.percentile_interval(S.resample_means(u, "question_id", ["condition"], 7, RESAMPLES), ["condition"]).select("condition", r6("lo").alias("lo"), r6("hi").alias("hi"), "n_undefined")


@query("mean_ci", f"WITH {TRACES_SQL}, u AS (SELECT model, question_id, sum(confidence) AS total, count(confidence) AS weight FROM traces GROUP BY ALL), {draw_sql(11, 'u', 'model', 'question_id')} SELECT model, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM rep GROUP BY 1")
def mean_ci(spark, sf):
    """Mean confidence by model; a question's traces are drawn together."""
    u = traces(spark, sf).groupBy("model", "question_id").agg(F.sum("confidence").alias("total"), F.count("confidence").alias("weight"))
    return S.percentile_interval(S.resample_means(u, "question_id", ["model"], 11, RESAMPLES), ["model"]).select("model", r6("lo").alias("lo"), r6("hi").alias("hi"))


_DIFF = """d AS (SELECT a.model, a.question_id, avg((a.label = 'correct')::INT) - avg((b.label = 'correct')::INT) AS total, 1 AS weight FROM traces a JOIN traces b ON a.question_id = b.question_id AND a.model = b.model AND a.condition = 'oracle' AND b.condition = 'retrieved' AND a.prompt = b.prompt WHERE a.label IS NOT NULL AND b.label IS NOT NULL GROUP BY ALL)"""


def paired(spark, sf):
    t = traces(spark, sf).filter("label IS NOT NULL").select("question_id", "condition", "model", "prompt", (F.col("label") == "correct").cast("int").alias("ok"))
    a, b = t.filter("condition = 'oracle'").drop("condition"), t.filter("condition = 'retrieved'").drop("condition").withColumnRenamed("ok", "base")
    return a.join(b, ["question_id", "model", "prompt"]).groupBy("model", "question_id").agg((F.avg("ok") - F.avg("base")).alias("total")).withColumn("weight", F.lit(1))


@query("paired_bootstrap", f"""WITH {TRACES_SQL}, {_DIFF}, {draw_sql(3, 'd', 'model', 'question_id')}, s AS (SELECT model, list(round(mean, 9) ORDER BY mean) AS m, avg((round(mean, 9) <= 0)::INT) AS p FROM rep GROUP BY 1), e AS (SELECT model, avg(total) AS diff FROM d GROUP BY 1)
SELECT model, round(diff, 6) AS diff, round(m[1 + floor(0.025 * {RESAMPLES})::INT], 6) AS lo, round(m[1 + least({RESAMPLES} - 1, floor(0.975 * {RESAMPLES}))::INT], 6) AS hi, round(p, 6) AS p_not_better FROM s JOIN e USING (model)""")
def paired_bootstrap(spark, sf):
    """Difference of two arms on shared questions; the interval takes sorted draws by index, not interpolated."""
    d = paired(spark, sf)
    rep = S.resample_means(d, "question_id", ["model"], 3, RESAMPLES).withColumn("mean", F.round("mean", 9))
    s = rep.groupBy("model").agg(F.sort_array(F.collect_list("mean")).alias("m"), F.avg((F.col("mean") <= 0).cast("int")).alias("p"))
    at = lambda q: F.element_at("m", F.lit(1 + min(RESAMPLES - 1, int(q * RESAMPLES))))
    return s.join(d.groupBy("model").agg(F.avg("total").alias("diff")), "model").select("model", r6("diff").alias("diff"), r6(at(0.025)).alias("lo"), r6(at(0.975)).alias("hi"), r6("p").alias("p_not_better"))


@query("paired_arm_difference", f"WITH {TRACES_SQL}, {_DIFF} SELECT model, count(*) AS n_questions, round(avg(total), 6) AS difference FROM d GROUP BY 1")
def paired_arm_difference(spark, sf):
    return paired(spark, sf).groupBy("model").agg(F.count("*").alias("n_questions"), r6(F.avg("total")).alias("difference"))


@query("permutation_baseline", f"""WITH {TRACES_SQL}, p AS (SELECT prompt, trace_id, (label = 'correct')::INT AS x, (confidence > 50)::INT AS y FROM traces WHERE label IS NOT NULL AND confidence IS NOT NULL AND condition = 'retrieved'),
f AS (SELECT prompt, x, row_number() OVER (PARTITION BY prompt ORDER BY trace_id) AS n FROM p), c AS (SELECT prompt, b, y, row_number() OVER (PARTITION BY prompt, b ORDER BY ('0x' || substr(md5(concat_ws('|', '5', b, trace_id)), 1, 8))::BIGINT, trace_id) AS n FROM p, (SELECT unnest(range({RESAMPLES})) AS b)),
r AS (SELECT b, avg((x = y)::INT) AS v FROM f JOIN c USING (prompt, n) GROUP BY b), o AS (SELECT avg((x = y)::INT) AS observed FROM p)
SELECT round(max(observed), 6) AS observed, round(avg(v), 6) AS baseline, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM r, o""")
def permutation_baseline(spark, sf):
    """Agreement of two flags against deals of one within prompts."""
    p = traces(spark, sf).filter("label IS NOT NULL AND confidence IS NOT NULL AND condition = 'retrieved'").select("prompt", "trace_id", (F.col("label") == "correct").cast("int").alias("x"), (F.col("confidence") > 50).cast("int").alias("y"))
    same = F.avg((F.col("x") == F.col("y")).cast("int"))
    r = S.permuted(p, "y", ["prompt"], "trace_id", 5, RESAMPLES).groupBy("b").agg(same.alias("v"))
    q = r.agg(F.avg("v").alias("baseline"), F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return p.agg(same.alias("observed")).crossJoin(q).select(r6("observed").alias("observed"), r6("baseline").alias("baseline"), r6(F.col("q")[0]).alias("lo"), r6(F.col("q")[1]).alias("hi"))


@query("seeded_sample", f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {sql_draw('s1', 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 3")
def seeded_sample(spark, sf):
    """Three documents of each source in the order of a seeded hash (a sampling operator)."""
    w = Window.partitionBy("source").orderBy(md5_int(F.lit("s1"), F.col("doc_id").cast("string")), "doc_id")
    return table(spark, sf, "documents").select("doc_id", "source").withColumn("r", F.row_number().over(w)).filter("r <= 3").drop("r")


@query("round_robin_sample", f"WITH {TRACES_SQL} SELECT trace_id, prompt, (row_number() OVER (ORDER BY r, prompt))::INT AS place FROM (SELECT trace_id, prompt, row_number() OVER (PARTITION BY prompt ORDER BY {sql_draw('rr', 'trace_id')}, trace_id) AS r FROM traces) ORDER BY place LIMIT 50")
def round_robin_sample(spark, sf):
    """One of every stratum in turn, fifty in all (a sampling operator)."""
    t = traces(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("prompt").orderBy(md5_int(F.lit("rr"), F.col("trace_id")), "trace_id")))
    # No stratum can give more than fifty of the first fifty.
    some = t.filter("r <= 50").orderBy("r", "prompt").limit(50)
    return some.select("trace_id", "prompt", F.row_number().over(Window.orderBy("r", "prompt")).alias("place"))


@query("first_seen_order", f"WITH {TRACES_SQL} SELECT label, (row_number() OVER (ORDER BY f))::INT AS place FROM (SELECT label, min(trace_id) AS f FROM traces WHERE label IS NOT NULL GROUP BY 1)")
def first_seen_order(spark, sf):
    first = traces(spark, sf).filter("label IS NOT NULL").groupBy("label").agg(F.min("trace_id").alias("f"))
    return first.select("label", F.row_number().over(Window.orderBy("f")).alias("place"))


@query("keep_last_section", "SELECT conv_id, role, turn AS last_turn, n > 1 AS duplicated FROM (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations) WHERE r = 1")
def keep_last_section(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.max("turn").alias("last_turn"), (F.count("*") > 1).alias("duplicated"))


_RATES = f"rates AS (SELECT condition, model, prompt, count(*) AS n, avg(coalesce(label = 'correct' AND fully_grounded, false)::INT) AS rate, avg(coalesce(label = 'correct', false)::INT) AS accuracy FROM traces LEFT JOIN grounded USING (trace_id) GROUP BY ALL)"


def arm_rates(spark, sf, runs=1):
    """Correct and fully grounded over all questions of the arm; null counts as not."""
    t = traces(spark, sf, runs).join(grounded(claims(spark, sf, runs)).select("trace_id", "fully_grounded"), "trace_id", "left")
    good, right = (F.col("label") == "correct") & F.col("fully_grounded"), F.col("label") == "correct"
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return t.withColumn("good", flag(good)).withColumn("right", flag(right))


@query("arm_ranking", f"WITH {CLAIMS_SQL}, {GROUNDED_SQL}, {_RATES} SELECT condition, model, prompt, n, round(rate, 6) AS rate, round(accuracy, 6) AS accuracy, (row_number() OVER (PARTITION BY condition ORDER BY round(rate, 6) DESC, round(accuracy, 6) DESC, prompt, model))::INT AS place FROM rates")
def arm_ranking(spark, sf):
    g = arm_rates(spark, sf).groupBy(*ARM).agg(F.count("*").alias("n"), r6(F.avg("good")).alias("rate"), r6(F.avg("right")).alias("accuracy"))
    w = Window.partitionBy("condition").orderBy(F.desc("rate"), F.desc("accuracy"), "prompt", "model")
    return g.withColumn("place", F.row_number().over(w))


@query("arm_selection", f"""WITH {CLAIMS_SQL}, {GROUNDED_SQL}, {_RATES}, k AS (SELECT *, row_number() OVER (ORDER BY round(rate, 6) DESC, round(accuracy, 6) DESC, prompt, model) AS place FROM rates WHERE condition = 'retrieved')
SELECT a.model, a.prompt, b.model AS second_model, b.prompt AS second_prompt, round(a.rate - b.rate, 6) AS lead FROM k a, k b WHERE a.place = 1 AND b.place = 2""")
def arm_selection(spark, sf):
    """The best arm and its lead over the next (a report of one row)."""
    g = arm_ranking(spark, sf).filter("condition = 'retrieved' AND place <= 2")
    one, two = g.filter("place = 1"), g.filter("place = 2").select(F.col("model").alias("second_model"), F.col("prompt").alias("second_prompt"), F.col("rate").alias("r2"))
    return one.crossJoin(two).select("model", "prompt", "second_model", "second_prompt", r6(F.col("rate") - F.col("r2")).alias("lead"))


@query("selection_lead_interval", f"""WITH {CLAIMS_SQL}, {GROUNDED_SQL}, {_RATES}, k AS (SELECT *, row_number() OVER (ORDER BY round(rate, 6) DESC, round(accuracy, 6) DESC, prompt, model) AS place FROM rates WHERE condition = 'retrieved'),
g AS (SELECT k.place, t.question_id, coalesce(label = 'correct' AND fully_grounded, false)::INT AS good FROM traces t LEFT JOIN grounded USING (trace_id) JOIN k ON k.condition = t.condition AND k.model = t.model AND k.prompt = t.prompt WHERE k.place <= 2),
u AS (SELECT 2 AS place, a.question_id, a.good - b.good AS total, 1 AS weight FROM g a JOIN g b ON a.question_id = b.question_id AND a.place = 1 AND b.place = 2), {draw_sql(37, 'u', 'place', 'question_id')}, o AS (SELECT avg(total) AS lead FROM u)
SELECT round(max(lead), 6) AS lead, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM rep, o""")
def selection_lead_interval(spark, sf):
    """The lead of the best arm over the next on shared questions, with its bootstrap interval."""
    top = arm_ranking(spark, sf).filter("condition = 'retrieved' AND place <= 2").select(*ARM, "place")
    g = arm_rates(spark, sf).join(F.broadcast(top), list(ARM)).select("place", "question_id", "good")
    u = g.filter("place = 1").select("question_id", F.col("good").alias("best")).join(g.filter("place = 2"), "question_id").select("place", "question_id", (F.col("best") - F.col("good")).alias("total"), F.lit(1).alias("weight"))
    i = S.percentile_interval(S.resample_means(u, "question_id", ["place"], 37, RESAMPLES), ["place"])
    return u.agg(F.avg("total").alias("lead")).crossJoin(i).select(r6("lead").alias("lead"), r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("pooled_replicate_diff", f"""WITH {CLAIMS_RUNS_SQL}, {GROUNDED_SQL}, g AS (SELECT *, coalesce(label = 'correct' AND fully_grounded, false)::INT AS good FROM traces LEFT JOIN grounded USING (trace_id)), q AS (SELECT model, prompt, question_id, avg(good) AS v FROM g WHERE condition = 'retrieved' GROUP BY ALL)
SELECT a.model, a.prompt, count(*) AS n, round(avg(a.v - b.v), 6) AS difference FROM q a JOIN q b ON a.question_id = b.question_id AND b.model = 'm1' AND b.prompt = 'p1' GROUP BY ALL""")
def pooled_replicate_diff(spark, sf):
    """Mean over runs by question first, then the difference from a base arm."""
    q = arm_rates(spark, sf, 3).filter("condition = 'retrieved'").groupBy("model", "prompt", "question_id").agg(F.avg("good").alias("v"))
    base = q.filter("model = 'm1' AND prompt = 'p1'").select("question_id", F.col("v").alias("b"))
    return q.join(base, "question_id").groupBy("model", "prompt").agg(F.count("*").alias("n"), r6(F.avg(F.col("v") - F.col("b"))).alias("difference"))


@query("selection_per_run", f"""WITH {CLAIMS_RUNS_SQL}, {GROUNDED_SQL}, r AS (SELECT run, model, prompt, round(avg(coalesce(label = 'correct' AND fully_grounded, false)::INT), 6) AS rate, round(avg(coalesce(label = 'correct', false)::INT), 6) AS accuracy FROM traces LEFT JOIN grounded USING (trace_id) WHERE condition = 'retrieved' GROUP BY ALL),
w AS (SELECT model, prompt FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY rate DESC, accuracy DESC, prompt, model) AS p FROM r) WHERE p = 1) SELECT model, prompt, count(*) AS wins FROM w GROUP BY ALL""")
def selection_per_run(spark, sf):
    r = arm_rates(spark, sf, 3).filter("condition = 'retrieved'").groupBy("run", "model", "prompt").agg(r6(F.avg("good")).alias("rate"), r6(F.avg("right")).alias("accuracy"))
    w = Window.partitionBy("run").orderBy(F.desc("rate"), F.desc("accuracy"), "prompt", "model")
    return r.withColumn("p", F.row_number().over(w)).filter("p = 1").groupBy("model", "prompt").agg(F.count("*").alias("wins"))


_MID = "rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"


@query("q1_retrieval_vs_grounded", f"""WITH {CLAIMS_SQL}, {GROUNDED_SQL}, found AS (SELECT query_id, recall FROM (WITH {CHUNKS}, {GOLD}, {RELEVANT}, {BM25}, {_METRICS} SELECT * FROM metrics) WHERE k = 5), v AS (SELECT question_id, any_value(recall) AS recall, avg(CASE WHEN condition = 'retrieved' THEN groundedness END) AS g, avg(CASE WHEN condition = 'oracle' THEN groundedness END) AS o, avg(CASE WHEN condition = 'retrieved' THEN (status = 'answered')::INT END) AS answered FROM traces JOIN found ON query_id = question_id LEFT JOIN grounded USING (trace_id) GROUP BY question_id),
u AS (SELECT 1 AS one, question_id, recall, round(g, 9) AS g, o, answered FROM v WHERE g IS NOT NULL), r AS (SELECT *, {_MID.format(by='one', c='recall')} AS rx, {_MID.format(by='one', c='g')} AS ry FROM u),
num AS (SELECT *, row_number() OVER (ORDER BY question_id) - 1 AS j, count(*) OVER () AS k FROM u), dr AS (SELECT b, ('0x' || substr(md5(concat_ws('|', '13', b, j)), 1, 8))::BIGINT % k AS pick FROM num, (SELECT unnest(range({RESAMPLES})) AS b)),
m AS (SELECT d.b, n.recall, n.g FROM dr d JOIN num n ON n.j = d.pick), q AS (SELECT b, {_MID.format(by='b', c='recall')} AS rx, {_MID.format(by='b', c='g')} AS ry FROM m),
c AS (SELECT b, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM q GROUP BY b), i AS (SELECT quantile_cont(rho, 0.025) AS lo, quantile_cont(rho, 0.975) AS hi FROM c)
SELECT count(*) AS n, round(CASE WHEN count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END, 6) AS rho, round(max(lo), 6) AS rho_lo, round(max(hi), 6) AS rho_hi, round(avg(CASE WHEN recall > 0 THEN g END) - avg(CASE WHEN recall = 0 THEN g END), 6) AS hit_minus_miss, round(avg(answered), 6) AS answer_rate,
count(CASE WHEN recall = 0 THEN o END) AS n_oracle_pairs, round(avg(CASE WHEN recall = 0 THEN o - g END), 6) AS oracle_minus_retrieved FROM r, i""")
def q1_retrieval_vs_grounded(spark, sf):
    """A unit for every question with evidence: rank correlation of the recall at five of lexical search with groundedness and its bootstrap interval, hits against misses, and what the oracle adds where nothing was found."""
    t = traces(spark, sf).join(grounded(claims(spark, sf)).select("trace_id", "groundedness"), "trace_id", "left")
    found = bm25_metrics(spark, sf).filter("k = 5").select(F.col("query_id").alias("question_id"), "recall")
    t = t.join(found, "question_id")
    of = lambda condition, c: F.avg(F.when(F.col("condition") == condition, c))
    u = t.groupBy("question_id", "recall").agg(F.round(of("retrieved", F.col("groundedness")), 9).alias("g"), of("oracle", F.col("groundedness")).alias("o"), of("retrieved", (F.col("status") == "answered").cast("int")).alias("answered")).filter("g IS NOT NULL")
    u = kept(u, "units")  # a row a question, read by the ranks and by the draws
    r = A.mid_ranks(A.mid_ranks(u, "recall", name="rx"), "g", name="ry")
    drawn = S.resampled(u.select("question_id", "recall", "g"), "question_id", [], 13, RESAMPLES)
    ranked = A.mid_ranks(A.mid_ranks(drawn, "recall", ["b"], name="rx"), "g", ["b"], name="ry")
    rho = ranked.groupBy("b").agg(N.guarded_corr(F.col("rx"), F.col("ry")).alias("mean"))
    interval = rho.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    hit = F.avg(F.when(F.col("recall") > 0, F.col("g"))) - F.avg(F.when(F.col("recall") == 0, F.col("g")))
    missed = F.col("recall") == 0
    one = r.agg(F.count("*").alias("n"), r6(N.guarded_corr(F.col("rx"), F.col("ry"))).alias("rho"), r6(hit).alias("hit_minus_miss"), r6(F.avg("answered")).alias("answer_rate"), F.count(F.when(missed, F.col("o"))).alias("n_oracle_pairs"), r6(F.avg(F.when(missed, F.col("o") - F.col("g")))).alias("oracle_minus_retrieved"))
    return one.crossJoin(interval).select("n", "rho", r6(F.col("q")[0]).alias("rho_lo"), r6(F.col("q")[1]).alias("rho_hi"), "hit_minus_miss", "answer_rate", "n_oracle_pairs", "oracle_minus_retrieved")


@query("q2_quadrants", f"""WITH {CLAIMS_SQL}, {GROUNDED_SQL}, x AS (SELECT *, {CORRECT} AS c FROM traces JOIN grounded USING (trace_id))
SELECT coalesce(condition, 'all') AS condition, coalesce(question_type, -1)::BIGINT AS question_type, count(*) AS n, count_if(c AND NOT fully_grounded) AS lucky, round(count_if(c AND NOT fully_grounded) / nullif(count_if(c), 0), 6) AS ungrounded_given_correct FROM x WHERE c IS NOT NULL AND fully_grounded IS NOT NULL GROUP BY CUBE (condition, question_type)""")
def q2_quadrants(spark, sf):
    x = traces(spark, sf).join(grounded(claims(spark, sf)).select("trace_id", "fully_grounded"), "trace_id").withColumn("c", N.is_correct(F.col("label"))).filter("c IS NOT NULL AND fully_grounded IS NOT NULL")
    g = x.cube("condition", "question_type").agg(F.count("*").alias("n"), F.count_if(F.col("c") & ~F.col("fully_grounded")).alias("lucky"), share(~F.col("fully_grounded"), F.col("c")).alias("ungrounded_given_correct"))
    return g.select(F.coalesce("condition", F.lit("all")).alias("condition"), F.coalesce("question_type", F.lit(-1)).cast("bigint").alias("question_type"), "n", "lucky", "ungrounded_given_correct")


@query("q2_ungrounded_interval", f"""WITH {CLAIMS_SQL}, {GROUNDED_SQL}, u AS (SELECT condition, question_id, count_if({CORRECT} AND NOT fully_grounded) AS total, count_if({CORRECT}) AS weight FROM traces JOIN grounded USING (trace_id) WHERE fully_grounded IS NOT NULL GROUP BY ALL), {draw_sql(17, 'u', 'condition', 'question_id')},
o AS (SELECT condition, sum(total) / sum(weight) AS rate FROM u GROUP BY 1) SELECT condition, round(max(rate), 6) AS ungrounded_given_correct, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM rep JOIN o USING (condition) GROUP BY 1""")
def q2_ungrounded_interval(spark, sf):
    """How often a correct answer is not fully grounded, with the interval over questions."""
    x = traces(spark, sf).join(grounded(claims(spark, sf)).select("trace_id", "fully_grounded"), "trace_id").filter("fully_grounded IS NOT NULL").withColumn("c", F.coalesce(N.is_correct(F.col("label")), F.lit(False)))
    u = x.groupBy("condition", "question_id").agg(F.count_if(F.col("c") & ~F.col("fully_grounded")).alias("total"), F.count_if("c").alias("weight"))
    i = S.percentile_interval(S.resample_means(u, "question_id", ["condition"], 17, RESAMPLES), ["condition"])
    rate = u.groupBy("condition").agg((F.sum("total") / F.sum("weight")).alias("rate"))
    return rate.join(i, "condition").select("condition", r6("rate").alias("ungrounded_given_correct"), r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("q2_mechanism", f"""WITH {CLAIMS_SQL}, {GROUNDED_SQL} SELECT condition, CASE WHEN bit_count(cited_bits) = 0 THEN 'nothing_cited' WHEN n_contradicted > 0 THEN 'contradicted' WHEN n_supported = 0 THEN 'nothing_supported' ELSE 'partly_supported' END AS mechanism, count(*) AS n
FROM traces JOIN grounded USING (trace_id) WHERE {CORRECT} AND NOT fully_grounded GROUP BY ALL""")
def q2_mechanism(spark, sf):
    """What kept correct answers from being grounded."""
    x = traces(spark, sf).join(grounded(claims(spark, sf)), "trace_id").filter(N.is_correct(F.col("label")) & ~F.col("fully_grounded"))
    why = F.when(F.bit_count("cited_bits") == 0, "nothing_cited").when(F.col("n_contradicted") > 0, "contradicted").when(F.col("n_supported") == 0, "nothing_supported").otherwise("partly_supported")
    return x.groupBy("condition", why.alias("mechanism")).agg(F.count("*").alias("n"))


@query("q2_review_sample", f"""WITH {CLAIMS_SQL}, {GROUNDED_SQL}, x AS (SELECT condition, trace_id, row_number() OVER (PARTITION BY condition ORDER BY {sql_draw('review', 'trace_id')}, trace_id) AS place FROM traces JOIN grounded USING (trace_id) WHERE {CORRECT} AND NOT fully_grounded) SELECT condition, trace_id, place::INT AS place FROM x WHERE place <= 5""")
def q2_review_sample(spark, sf):
    """Five correct but ungrounded answers of each condition for a reader, in seeded order (a sampling operator)."""
    x = traces(spark, sf).join(grounded(claims(spark, sf)).select("trace_id", "fully_grounded"), "trace_id").filter(N.is_correct(F.col("label")) & ~F.col("fully_grounded"))
    w = Window.partitionBy("condition").orderBy(md5_int(F.lit("review"), F.col("trace_id")), "trace_id")
    return x.select("condition", "trace_id", F.row_number().over(w).alias("place")).filter("place <= 5")


@query("q3_sensitivity", f"""WITH {CLAIMS_SQL}, {GROUNDED_SQL}, x AS (SELECT t.below, confidence < t.below AS doubtful, NOT fully_grounded AS ungrounded FROM traces JOIN grounded USING (trace_id), (VALUES (30), (50), (70), (90)) t(below) WHERE confidence IS NOT NULL AND fully_grounded IS NOT NULL)
SELECT below, count(*) AS n, round(count_if(doubtful AND ungrounded) / nullif(count_if(doubtful OR ungrounded), 0), 6) AS jaccard, round(avg((doubtful = ungrounded)::INT), 6) AS agreement FROM x GROUP BY below""")
def q3_sensitivity(spark, sf):
    """Agreement of low confidence and lack of grounding for several thresholds of confidence."""
    x = traces(spark, sf).join(grounded(claims(spark, sf)).select("trace_id", "fully_grounded"), "trace_id").filter("confidence IS NOT NULL AND fully_grounded IS NOT NULL").withColumn("below", F.explode(F.array(*[F.lit(b) for b in (30, 50, 70, 90)])))
    doubtful, ungrounded = F.col("confidence") < F.col("below"), ~F.col("fully_grounded")
    return x.groupBy("below").agg(F.count("*").alias("n"), r6(A.jaccard(doubtful, ungrounded)).alias("jaccard"), r6(F.avg((doubtful == ungrounded).cast("int"))).alias("agreement"))


_SIGNALS = "(CASE WHEN confidence IS NOT NULL THEN (confidence >= 70)::INT END)"


@query("q3_signal_pairs", f"""WITH {CLAIMS_SQL}, {GROUNDED_SQL}, x AS (SELECT trace_id, fully_grounded::INT AS grounded, ({CORRECT})::INT AS correct, {_SIGNALS} AS confident, (bit_count(cited_bits) >= 2)::INT AS cited FROM traces LEFT JOIN grounded USING (trace_id)),
s AS (SELECT trace_id, 'grounded' AS name, grounded AS v FROM x UNION ALL SELECT trace_id, 'correct', correct FROM x UNION ALL SELECT trace_id, 'confident', confident FROM x UNION ALL SELECT trace_id, 'cited', cited FROM x)
SELECT a.name AS a, b.name AS b, count(*) AS n, round(avg((a.v = b.v)::INT), 6) AS agreement, round(count_if(a.v = 1 AND b.v = 1) / nullif(count_if(a.v = 1 OR b.v = 1), 0), 6) AS jaccard, greatest(avg(a.v), 1 - avg(a.v)) >= 0.9 OR greatest(avg(b.v), 1 - avg(b.v)) >= 0.9 AS no_variance FROM s a JOIN s b ON a.trace_id = b.trace_id AND a.name < b.name WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL""")
def q3_signal_pairs(spark, sf):
    """Six pairs of four signals from one scan: the pairs of a row are made as an array, not by a self-join."""
    t = traces(spark, sf).join(grounded(claims(spark, sf)).select("trace_id", "fully_grounded"), "trace_id", "left")
    signals = {"grounded": F.col("fully_grounded").cast("int"), "correct": N.is_correct(F.col("label")).cast("int"), "confident": (F.col("confidence") >= 70).cast("int"), "cited": (F.bit_count("cited_bits") >= 2).cast("int")}
    names = sorted(signals)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), signals[a].alias("x"), signals[b].alias("y")) for i, a in enumerate(names) for b in names[i + 1 :]])
    p = t.select(F.explode(pairs).alias("p")).select("p.*").filter("x IS NOT NULL AND y IS NOT NULL")
    one_sided = lambda c: F.greatest(F.avg(c), 1 - F.avg(c)) >= 0.9
    return p.groupBy("a", "b").agg(F.count("*").alias("n"), r6(F.avg((F.col("x") == F.col("y")).cast("int"))).alias("agreement"), r6(A.jaccard(F.col("x") == 1, F.col("y") == 1)).alias("jaccard"), (one_sided("x") | one_sided("y")).alias("no_variance"))


@query("q4_categories", f"WITH {TRACES_SQL} SELECT chr((97 + question_id % 4)::INT) AS category, condition, model, count(*) AS n, round(avg(coalesce(label = 'correct', false)::INT), 6) AS accuracy, round(avg((status = 'declined')::INT), 6) AS decline_rate FROM traces GROUP BY ALL")
def q4_categories(spark, sf):
    category = F.element_at(F.array(*[F.lit(c) for c in "abcd"]), (F.col("question_id") % 4).cast("int") + 1).alias("category")
    return traces(spark, sf).groupBy(category, "condition", "model").agg(F.count("*").alias("n"), r6(F.avg(F.coalesce(F.col("label") == "correct", F.lit(False)).cast("int"))).alias("accuracy"), r6(F.avg((F.col("status") == "declined").cast("int"))).alias("decline_rate"))


@query("q4_difference", f"""WITH {TRACES_SQL}, c AS (SELECT condition, model, question_id, question_id % 4 AS cat, avg(coalesce(label = 'correct', false)::INT) AS v FROM traces WHERE question_id % 4 < 2 GROUP BY ALL),
u AS (SELECT condition, model, cat, question_id, v AS total, 1 AS weight FROM c), {draw_sql(19, 'u', 'condition, model, cat', 'question_id')}, d AS (SELECT a.condition, a.model, a.b, b.mean - a.mean AS diff FROM rep a JOIN rep b ON a.condition = b.condition AND a.model = b.model AND a.b = b.b AND a.cat = 0 AND b.cat = 1),
o AS (SELECT condition, model, avg(CASE WHEN cat = 1 THEN v END) - avg(CASE WHEN cat = 0 THEN v END) AS observed FROM c GROUP BY ALL)
SELECT condition, model, round(max(observed), 6) AS difference, round(quantile_cont(diff, 0.025), 6) AS lo, round(quantile_cont(diff, 0.975), 6) AS hi FROM d JOIN o USING (condition, model) GROUP BY ALL""")
def q4_difference(spark, sf):
    """Accuracy on category b less that on category a, with the interval of independent draws of both."""
    c = traces(spark, sf).withColumn("k", F.col("question_id") % 4).filter("k < 2").groupBy("condition", "model", "question_id", "k").agg(F.avg(F.coalesce(F.col("label") == "correct", F.lit(False)).cast("int")).alias("total")).withColumn("weight", F.lit(1))
    rep = S.resample_means(c, "question_id", ["condition", "model", "k"], 19, RESAMPLES)
    two = rep.groupBy("condition", "model", "b").agg((F.max(F.when(F.col("k") == 1, F.col("mean"))) - F.max(F.when(F.col("k") == 0, F.col("mean")))).alias("mean"))
    i = S.percentile_interval(two, ["condition", "model"])
    o = c.groupBy("condition", "model").agg((F.avg(F.when(F.col("k") == 1, F.col("total"))) - F.avg(F.when(F.col("k") == 0, F.col("total")))).alias("d"))
    return o.join(i, ["condition", "model"]).select("condition", "model", r6("d").alias("difference"), r6("lo").alias("lo"), r6("hi").alias("hi"))


_ARM_KEYS = "condition, model, prompt"


def _interval_sql(name: str, units: str, seed: int) -> str:
    """Lower and upper bound of every arm's mean, as the table ``name``; the working tables get the name too."""
    sql = draw_sql(seed, units, _ARM_KEYS, "question_id")
    for old in ("sd", "sd1", "sd2", "seeded", "un", "dw", "dw1", "dw2", "rep"):
        sql = re.sub(rf"\b{old}\b", f"{old}_{name}", sql)
    return f"{sql}, {name} AS (SELECT {_ARM_KEYS}, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM rep_{name} GROUP BY ALL)"


@query("q5_prompt_contrast", f"""WITH {CLAIMS_SQL}, {GROUNDED_SQL}, s AS (SELECT trace_id, max(cited_bits) AS cited, bit_or(CASE WHEN kind = 'document' AND judge = 'supported' THEN support_bits ELSE 0 END) AS support FROM claims GROUP BY 1),
x AS (SELECT condition, model, prompt, question_id, groundedness AS g, bit_count(cited & support) / nullif(bit_count(cited), 0) AS p, (status = 'answered')::INT AS answered FROM traces JOIN grounded USING (trace_id) JOIN s USING (trace_id)),
d AS (SELECT t.condition, t.model, t.prompt, t.question_id, t.g - b.g AS dg, t.p - b.p AS dp, t.answered - b.answered AS da FROM x t JOIN x b ON t.question_id = b.question_id AND t.condition = b.condition AND t.model = b.model AND b.prompt = 'p1' AND t.prompt <> 'p1' WHERE t.g IS NOT NULL AND b.g IS NOT NULL),
ug AS (SELECT condition, model, prompt, question_id, dg AS total, 1 AS weight FROM d), up AS (SELECT condition, model, prompt, question_id, dp AS total, 1 AS weight FROM d WHERE dp IS NOT NULL),
{_interval_sql('ig', 'ug', 23)}, {_interval_sql('ip', 'up', 29)}, a AS (SELECT {_ARM_KEYS}, count(*) AS n, round(avg(dg), 6) AS d_groundedness, round(avg(dp), 6) AS d_precision, round(avg(da), 6) AS d_answered FROM d GROUP BY ALL)
SELECT a.*, ig.lo AS g_lo, ig.hi AS g_hi, ip.lo AS p_lo, ip.hi AS p_hi, CASE WHEN ig.lo > 0 THEN 'real_improvement' WHEN ig.hi < 0 THEN 'worse' WHEN ip.hi < 0 THEN 'apparent_only' ELSE 'no_effect' END AS reading FROM a JOIN ig USING ({_ARM_KEYS}) LEFT JOIN ip USING ({_ARM_KEYS})""")
def q5_prompt_contrast(spark, sf):
    """Each prompt against the base on the questions scored in both: changes of groundedness and citation precision with bootstrap intervals, read together."""
    c = claims(spark, sf)
    ok = (F.col("kind") == "document") & (F.col("judge") == "supported")
    cited = c.groupBy("trace_id").agg(F.max("cited_bits").alias("cited"), F.bit_or(F.when(ok, F.col("support_bits")).otherwise(F.lit(0))).alias("support"))
    x = traces(spark, sf).join(grounded(c).select("trace_id", "groundedness"), "trace_id").join(cited, "trace_id").filter("groundedness IS NOT NULL")
    x = x.select(*ARM, "question_id", F.col("groundedness").alias("g"), F.try_divide(F.bit_count(F.col("cited").bitwiseAND(F.col("support"))), F.bit_count("cited")).alias("p"), (F.col("status") == "answered").cast("int").alias("answered"))
    base = x.filter("prompt = 'p1'").select("question_id", "condition", "model", F.col("g").alias("g0"), F.col("p").alias("p0"), F.col("answered").alias("a0"))
    d = x.filter("prompt <> 'p1'").join(base, ["question_id", "condition", "model"]).select(*ARM, "question_id", (F.col("g") - F.col("g0")).alias("dg"), (F.col("p") - F.col("p0")).alias("dp"), (F.col("answered") - F.col("a0")).alias("da"))

    def interval(column: str, name: str, seed: int):
        u = d.filter(F.col(column).isNotNull()).select(*ARM, "question_id", F.col(column).alias("total"), F.lit(1).alias("weight"))
        return S.percentile_interval(S.resample_means(u, "question_id", ARM, seed, RESAMPLES), ARM).select(*ARM, r6("lo").alias(f"{name}_lo"), r6("hi").alias(f"{name}_hi"))

    g = d.groupBy(*ARM).agg(F.count("*").alias("n"), r6(F.avg("dg")).alias("d_groundedness"), r6(F.avg("dp")).alias("d_precision"), r6(F.avg("da")).alias("d_answered"))
    both = g.join(interval("dg", "g", 23), list(ARM)).join(interval("dp", "p", 29), list(ARM), "left")
    return both.withColumn("reading", N.interval_reading((F.col("g_lo"), F.col("g_hi")), (F.col("p_lo"), F.col("p_hi"))))


#: What the analysis takes from each of its questions: keys of a row, and measures.
ANALYSIS = {
    "q1_retrieval_vs_grounded": ((), ("n", "rho", "rho_lo", "rho_hi", "hit_minus_miss", "answer_rate", "oracle_minus_retrieved")),
    "q2_quadrants": (("condition", "question_type"), ("n", "lucky", "ungrounded_given_correct")),
    "q2_ungrounded_interval": (("condition",), ("ungrounded_given_correct", "lo", "hi")),
    "q3_signal_pairs": (("a", "b"), ("n", "agreement", "jaccard")),
    "q5_prompt_contrast": (ARM, ("n", "d_groundedness", "g_lo", "g_hi", "d_precision", "p_lo", "p_hi")),
    "human_check": (("prompt", "rater"), ("n", "groundedness")),
}


def analysis_report(spark, sf):
    """The whole analysis as one table: question, cell, measure, value."""
    out = None
    for name, (keys, measures) in ANALYSIS.items():
        cell = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
        part = PLANS[name](spark, sf).select(F.lit(name).alias("question"), cell.alias("cell"), F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("m")).select("question", "cell", "m.*")
        out = part if out is None else out.unionByName(part)
    return out


def _analysis_sql() -> str:
    parts = []
    for name, (keys, measures) in ANALYSIS.items():
        cell = f"concat_ws('/', {', '.join(f'{k}::VARCHAR' for k in keys)})" if keys else "''"
        rows = ", ".join(f"{{'measure': '{m}', 'value': {m}::DOUBLE}}" for m in measures)
        parts.append(f"SELECT question, cell, unnest(m, recursive := true) FROM (SELECT '{name}' AS question, {cell} AS cell, unnest([{rows}]) AS m FROM ({SQL[name]}))")
    return " UNION ALL ".join(parts)


@query("human_check", f"WITH {CLAIMS_SQL}, s AS (SELECT prompt, 'judge' AS rater, judge AS v FROM claims WHERE kind = 'document' UNION ALL SELECT prompt, 'human', human FROM claims WHERE kind = 'document') SELECT prompt, rater, count(*) AS n, round(avg((v = 'supported')::INT), 6) AS groundedness FROM s GROUP BY ALL")
def human_check(spark, sf):
    """The same statistic under either rater on the same claims."""
    both = claims(spark, sf).filter("kind = 'document'").select("prompt", F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("v")) for r in ("judge", "human")])).alias("s")).select("prompt", "s.*")
    return both.groupBy("prompt", "rater").agg(F.count("*").alias("n"), r6(F.avg((F.col("v") == "supported").cast("int"))).alias("groundedness"))


@query("prediction_check", f"WITH {TRACES_SQL}, v AS (SELECT model, avg(coalesce(label = 'correct', false)::INT) AS rate FROM traces GROUP BY 1), p(prediction, model, lo, hi) AS (VALUES ('a', 'm1', 0.2, 0.5), ('b', 'm2', 0.5, 'inf'::DOUBLE), ('c', 'm9', 0.1, 0.25)) SELECT prediction, p.model, round(rate, 6) AS value, rate BETWEEN lo AND hi AS held FROM p LEFT JOIN v USING (model)")
def prediction_check(spark, sf):
    """Predicted ranges against results; null where there is no result."""
    from ..functions.text import range_bounds
    from ..registry import literal_rows

    v = traces(spark, sf).groupBy("model").agg(F.avg(F.coalesce(F.col("label") == "correct", F.lit(False)).cast("int")).alias("rate"))
    p = literal_rows(spark, [("a", "m1", "0.2 to 0.5"), ("b", "m2", ">= 0.5"), ("c", "m9", "10-25%")], "prediction string, model string, option string").withColumn("r", range_bounds(F.col("option")))
    return p.join(v, "model", "left").select("prediction", "model", r6("rate").alias("value"), ((F.col("rate") >= F.col("r.lo")) & (F.col("rate") <= F.col("r.hi"))).alias("held"))


@query("review_summary", f"WITH {TRACES_SQL}, s AS (SELECT trace_id, {sql_draw('rev', 'trace_id')} % 5 AS d FROM traces WHERE {sql_draw('pick', 'trace_id')} % 8 = 0) SELECT count(*) AS n, count_if(d = 0) AS open, count_if(d IN (1, 2)) AS judge_right, count_if(d IN (3, 4)) AS judge_wrong, round(count_if(d IN (1, 2)) / nullif(count_if(d > 0), 0), 6) AS judge_right_share, CASE WHEN count_if(d > 0) = 0 THEN 'not_done' WHEN count_if(d = 0) > 0 THEN 'incomplete' ELSE 'complete' END AS state FROM s")
def review_summary(spark, sf):
    s = traces(spark, sf).filter(md5_int(F.lit("pick"), F.col("trace_id")) % 8 == 0).select((md5_int(F.lit("rev"), F.col("trace_id")) % 5).alias("d"))
    done, right = F.count_if(F.col("d") > 0), F.count_if(F.col("d").isin(1, 2))
    state = F.when(done == 0, "not_done").when(F.count_if(F.col("d") == 0) > 0, "incomplete").otherwise("complete")
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("open"), right.alias("judge_right"), F.count_if(F.col("d").isin(3, 4)).alias("judge_wrong"), r6(F.try_divide(right, done)).alias("judge_right_share"), state.alias("state"))


@query("external_faithfulness", f"""WITH {CLAIMS_SQL}, x AS (SELECT trace_id, avg((human = 'supported')::INT) AS h, avg((second = 'supported')::INT) AS e FROM claims WHERE kind = 'document' GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0 AS rh, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS re FROM x)
SELECT count(*) AS n, round(avg(h), 6) AS human, round(avg(e), 6) AS external, round(avg(abs(h - e)), 6) AS gap, round(corr(rh, re), 6) AS rho FROM r""")
def external_faithfulness(spark, sf):
    x = claims(spark, sf).filter("kind = 'document'").groupBy("trace_id").agg(F.avg((F.col("human") == "supported").cast("int")).alias("h"), F.avg((F.col("second") == "supported").cast("int")).alias("e"))
    r = A.mid_ranks(A.mid_ranks(x, "h", name="rh"), "e", name="re")
    return r.agg(F.count("*").alias("n"), r6(F.avg("h")).alias("human"), r6(F.avg("e")).alias("external"), r6(F.avg(F.abs(F.col("h") - F.col("e")))).alias("gap"), r6(N.guarded_corr(F.col("rh"), F.col("re"))).alias("rho"))


@query("claim_verdict_zip", f"WITH {CLAIMS_SQL}, n AS (SELECT trace_id, count(*) AS n, count(DISTINCT claim) AS ids, min(claim) AS lo, max(claim) AS hi FROM claims WHERE {sql_draw('drop', 'trace_id', 'claim')} % 30 <> 0 GROUP BY 1) SELECT t.trace_id, coalesce(n = t.n_claims AND ids = n AND lo = 1 AND hi = n, false) AS complete FROM traces t LEFT JOIN n USING (trace_id) WHERE status IN ('answered', 'partial') AND t.n_claims > 0")
def claim_verdict_zip(spark, sf):
    """Every claim of 1..n has exactly one verdict (some are lost here by a seeded draw)."""
    kept = claims(spark, sf).filter(md5_int(F.lit("drop"), F.col("trace_id"), F.col("claim").cast("string")) % 30 != 0)
    n = kept.groupBy("trace_id").agg(F.count("*").alias("n"), F.countDistinct("claim").alias("ids"), F.min("claim").alias("lo"), F.max("claim").alias("hi"))
    t = traces(spark, sf).filter(F.col("status").isin("answered", "partial") & (F.col("n_claims") > 0)).select("trace_id", "n_claims").join(n, "trace_id", "left")
    whole = (F.col("n") == F.col("n_claims")) & (F.col("ids") == F.col("n")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))
    return t.select("trace_id", F.coalesce(whole, F.lit(False)).alias("complete"))


@query("label_attachment", f"WITH {CLAIMS_SQL} SELECT substr(sha256(trace_id), 1, 12) AS item_id, claim, human AS blind, CASE WHEN {sql_draw('adj', 'trace_id', 'claim')} % 6 = 0 THEN judge END AS adjudicated, CASE WHEN {sql_draw('adj', 'trace_id', 'claim')} % 6 = 0 THEN judge ELSE human END AS final FROM claims")
def label_attachment(spark, sf):
    """Blind labels by opaque item and claim; adjudicated ones beside them and in their stead."""
    c = claims(spark, sf).withColumn("item_id", F.substring(F.sha2("trace_id", 256), 1, 12))
    changed = c.filter(md5_int(F.lit("adj"), F.col("trace_id"), F.col("claim").cast("string")) % 6 == 0).select("item_id", "claim", F.col("judge").alias("adjudicated"))
    joined = c.select("item_id", "claim", F.col("human").alias("blind")).join(changed, ["item_id", "claim"], "left")
    return joined.withColumn("final", F.coalesce("adjudicated", "blind"))


@query("flat_analysis_rows", f"WITH {CLAIMS_SQL}, {GROUNDED_SQL} SELECT trace_id, question_id, condition, model, prompt, status, label, {CORRECT} AS correct, confidence, round(groundedness, 6) AS groundedness, fully_grounded, bit_count(cited_bits)::INT AS n_cited FROM traces LEFT JOIN grounded USING (trace_id)")
def flat_analysis_rows(spark, sf):
    """The nested record of a trace (facts, evaluation) flattened to one row."""
    t = traces(spark, sf).join(grounded(claims(spark, sf)), "trace_id", "left")
    nested = t.select("trace_id", F.struct("question_id", *ARM).alias("arm"), F.struct("status", "label", "confidence", "cited_bits").alias("output"), F.struct("groundedness", "fully_grounded").alias("evaluation"))
    return nested.select("trace_id", "arm.question_id", *[f"arm.{c}" for c in ARM], "output.status", "output.label", N.is_correct(F.col("output.label")).alias("correct"), "output.confidence", r6("evaluation.groundedness").alias("groundedness"), "evaluation.fully_grounded", F.bit_count("output.cited_bits").alias("n_cited"))


@query("quota_check", f"WITH {TRACES_SQL}, e(label, want) AS (VALUES ('correct', 200), ('incorrect', 40), ('abstained', 100), ('refused', 1)) SELECT e.label, e.want, count(t.label) AS have, count(t.label) >= e.want AS met FROM e LEFT JOIN traces t ON t.label = e.label GROUP BY e.label, e.want")
def quota_check(spark, sf):
    from ..registry import literal_rows

    have = traces(spark, sf).groupBy("label").agg(F.count("*").alias("have"))
    want = literal_rows(spark, [("correct", 200), ("incorrect", 40), ("abstained", 100), ("refused", 1)], "label string, want int")
    return want.join(have, "label", "left").select("label", "want", F.coalesce("have", F.lit(0)).alias("have")).withColumn("met", F.col("have") >= F.col("want"))


@query("evidence_consistency", f"""WITH {CLAIMS_SQL}, x AS (SELECT trace_id, max(n_claims) AS told, count(*) AS n, max(cited_bits) AS cited, bit_or(CASE WHEN judge = 'supported' THEN support_bits ELSE 0 END) AS support, count_if(judge = 'supported' AND support_bits = 0) AS bare, count_if(judge <> 'supported' AND support_bits <> 0) AS stray FROM claims GROUP BY 1)
SELECT count(*) AS checked, count_if(told <> n) AS lost_claims, sum(stray)::BIGINT AS stray_excerpts, sum(bare)::BIGINT AS supported_without_excerpt, count_if(cited & support = 0 AND cited > 0) AS cites_nothing_that_supports FROM x""")
def evidence_consistency(spark, sf):
    """Claims against the traces and excerpts they name: the first two counts must be 0, the others say how often evidence is missing."""
    c, supported = claims(spark, sf), F.col("judge") == "supported"
    numbers = traces(spark, sf).select("trace_id", "n_claims")
    x = c.join(numbers, "trace_id").groupBy("trace_id").agg(
        F.max("n_claims").alias("told"), F.count("*").alias("n"), F.max("cited_bits").alias("cited"), F.bit_or(F.when(supported, F.col("support_bits")).otherwise(0)).alias("support"),
        F.count_if(supported & (F.col("support_bits") == 0)).alias("bare"), F.count_if(~supported & (F.col("support_bits") != 0)).alias("stray"),
    )
    meets = F.col("cited").bitwiseAND(F.col("support"))
    return x.agg(F.count("*").alias("checked"), F.count_if(F.col("told") != F.col("n")).alias("lost_claims"), F.sum("stray").alias("stray_excerpts"), F.sum("bare").alias("supported_without_excerpt"), F.count_if((meets == 0) & (F.col("cited") > 0)).alias("cites_nothing_that_supports"))


@query("judge_stages", f"WITH {CLAIMS_SQL}, s AS (SELECT trace_id, status IN ('answered', 'partial') AS needs_judge, n_claims > 0 AS has_claims, status <> 'declined' AND label IS NOT NULL AS graded FROM traces) SELECT count_if(needs_judge) AS decomposed, count_if(needs_judge AND has_claims) AS verified, count_if(needs_judge AND graded) AS graded, count_if(NOT needs_judge) AS skipped FROM s")
def judge_stages(spark, sf):
    """Which traces each stage of judging takes from the one before."""
    needs, has, graded = F.col("status").isin("answered", "partial"), F.col("n_claims") > 0, (F.col("status") != "declined") & F.col("label").isNotNull()
    return traces(spark, sf).agg(F.count_if(needs).alias("decomposed"), F.count_if(needs & has).alias("verified"), F.count_if(needs & graded).alias("graded"), F.count_if(~needs).alias("skipped"))


@query("evaluation_record", f"WITH {CLAIMS_SQL}, {GROUNDED_SQL} SELECT trace_id, CASE WHEN status = 'declined' THEN 'abstained' WHEN status = 'unparsed' THEN 'unparsed' WHEN confidence > 90 THEN 'correct' ELSE label END AS final_label, CASE WHEN status = 'declined' THEN 'rule' WHEN status = 'unparsed' THEN 'output' WHEN confidence > 90 THEN 'numeric' WHEN label IS NOT NULL THEN 'judge' ELSE 'none' END AS source, coalesce(n_document, 0) AS n_document FROM traces LEFT JOIN grounded USING (trace_id)")
def evaluation_record(spark, sf):
    """Label precedence: abstained, unparsed, numeric grader, judge, none."""
    order = [(F.col("status") == "declined", F.lit("abstained"), "rule"), (F.col("status") == "unparsed", F.lit("unparsed"), "output"), (F.col("confidence") > 90, F.lit("correct"), "numeric"), (F.col("label").isNotNull(), F.col("label"), "judge")]
    label, source = F.lit(None).cast("string"), F.lit("none")
    for test, value, name in reversed(order):
        label, source = F.when(test, value).otherwise(label), F.when(test, name).otherwise(source)
    t = traces(spark, sf).join(grounded(claims(spark, sf)).select("trace_id", "n_document"), "trace_id", "left")
    return t.select("trace_id", label.alias("final_label"), source.alias("source"), F.coalesce("n_document", F.lit(0)).alias("n_document"))


@query("interval_readings", """WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 < 5 THEN (o_orderkey % 21 - 10) / 10.0 END AS a, CASE WHEN o_orderkey % 5 < 3 THEN (o_orderkey % 15 - 10) / 10.0 END AS c FROM orders)
SELECT id, CASE WHEN a IS NULL THEN 'undetermined' WHEN a > 0 THEN 'real_improvement' WHEN a + 0.45 < 0 THEN 'worse' WHEN c + 0.25 < 0 THEN 'apparent_only' ELSE 'no_effect' END AS reading FROM x""")
def interval_readings(spark, sf):
    """Intervals of several signs, some of them missing, read together."""
    key = F.col("o_orderkey")
    a, c = F.when(key % 6 < 5, (key % 21 - 10) / 10.0), F.when(key % 5 < 3, (key % 15 - 10) / 10.0)
    return table(spark, sf, "orders").select(key.alias("id"), N.interval_reading((a, a + 0.45), (c, c + 0.25)).alias("reading"))


query("analysis_report", _analysis_sql())(analysis_report)
