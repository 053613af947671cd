"""Evaluation fact tables derived from the supplied tables by seeded hashes: traces, claims, raters.

Every value is a function of the row's keys, so the tables are the same in any engine
and need no state.  ``*_SQL`` hold the same tables as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import md5_int
from ..registry import table

KEYS = ("question_id", "condition", "model", "prompt")


def draw(tag: str, *keys: str):
    return md5_int(F.lit(tag), *[F.col(k).cast("string") for k in keys])


def sql_draw(tag: str, *keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{tag}', {', '.join(keys)})), 1, 8))::BIGINT"


def traces(spark: SparkSession, sf_dir: str, runs: int = 1) -> DataFrame:
    """One row per question, condition, model, prompt and run."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"))
    grid = items
    for name, values in (("condition", ("retrieved", "oracle")), ("model", ("m1", "m2")), ("prompt", ("p1", "p2", "p3", "p4"))):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    grid = grid.withColumn("run", F.explode(F.array(*[F.lit(r) for r in range(runs)])))
    keys = (*KEYS, "run")
    st, lb = draw("st", *keys) % 10, draw("lb", *keys) % 6
    status = F.when(st <= 5, "answered").when(st == 6, "partial").when(st <= 8, "declined").otherwise("unparsed")
    grade = F.when(lb <= 2, "correct").when(lb == 3, "partially_correct").when(lb == 4, "incorrect").otherwise("unit_error")
    rows = grid.withColumn("status", status)
    label = F.when(draw("je", *keys) % 40 == 0, F.lit(None)).when(F.col("status").isin("answered", "partial"), grade).when(F.col("status") == "declined", "abstained").otherwise("unparsed")
    return rows.select(
        F.concat_ws("__", *[F.col(k).cast("string") for k in keys]).alias("trace_id"), *keys, "status", label.alias("label"),
        F.when(draw("cn", *keys) % 20 != 0, draw("cf", *keys) % 101).alias("confidence"),
        (F.col("question_id") % 3).alias("question_type"), (draw("ic", "question_id") % 4 != 0).alias("in_corpus"), (draw("cb", *keys) % 32).alias("cited_bits"),
        (draw("nc", *keys) % 6).alias("n_claims"),
    )


def _traces_sql(runs: int) -> str:
    keys = ("question_id", "condition", "model", "prompt", "run")
    d = lambda tag: sql_draw(tag, *keys)
    run_values = ", ".join(f"({r})" for r in range(runs))
    return f"""grid AS (SELECT item_id AS question_id, c.condition, m.model, p.prompt, r.run::INTEGER AS run FROM benchmark, (VALUES ('retrieved'), ('oracle')) c(condition),
  (VALUES ('m1'), ('m2')) m(model), (VALUES ('p1'), ('p2'), ('p3'), ('p4')) p(prompt), (VALUES {run_values}) r(run)),
graded AS (SELECT *, CASE WHEN {d('st')} % 10 <= 5 THEN 'answered' WHEN {d('st')} % 10 = 6 THEN 'partial' WHEN {d('st')} % 10 <= 8 THEN 'declined' ELSE 'unparsed' END AS status FROM grid),
traces AS (SELECT concat_ws('__', question_id, condition, model, prompt, run) AS trace_id, question_id, condition, model, prompt, run, status,
  CASE WHEN {d('je')} % 40 = 0 THEN NULL WHEN status IN ('answered', 'partial') THEN CASE WHEN {d('lb')} % 6 <= 2 THEN 'correct' WHEN {d('lb')} % 6 = 3 THEN 'partially_correct'
    WHEN {d('lb')} % 6 = 4 THEN 'incorrect' ELSE 'unit_error' END WHEN status = 'declined' THEN 'abstained' ELSE 'unparsed' END AS label,
  CASE WHEN {d('cn')} % 20 <> 0 THEN {d('cf')} % 101 END AS confidence, question_id % 3 AS question_type, {sql_draw('ic', 'question_id')} % 4 <> 0 AS in_corpus,
  {d('cb')} % 32 AS cited_bits, {d('nc')} % 6 AS n_claims FROM graded)"""


TRACES_SQL = _traces_sql(1)
RUNS_SQL = _traces_sql(3)


def claims(spark: SparkSession, sf_dir: str, runs: int = 1) -> DataFrame:
    """Claims of answered traces: kind, the verdicts of four raters, the excerpts that support each."""
    t = traces(spark, sf_dir, runs).filter(F.col("status").isin("answered", "partial") & (F.col("n_claims") > 0))
    rows = t.withColumn("claim", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_claims"))))
    k = ("trace_id", "claim")
    kind = F.when(draw("ck", *k) % 10 <= 6, "document").when(draw("ck", *k) % 10 <= 8, "context").otherwise("general")
    base = draw("v", *k) % 10

    def rater(name: str, noise: int):
        flip = draw(name, *k) % 100 < noise
        moved = F.when(flip, (base + 5) % 10).otherwise(base)
        return F.when(moved <= 6, "supported").when(moved <= 8, "unsupported").otherwise("contradicted").alias(name)

    rated = rows.select(*[c for c in t.columns if c != "n_claims"], "claim", kind.alias("kind"), rater("judge", 0), rater("second", 15), rater("retest", 4), rater("human", 25), (draw("sb", *k) % 32).alias("bits"))
    return rated.withColumn("support_bits", F.when(F.col("judge") == "supported", F.col("bits")).otherwise(F.lit(0))).drop("bits")


def _claims_sql() -> str:
    d = lambda tag: sql_draw(tag, "trace_id", "claim")

    def rater(name: str, noise: int) -> str:
        moved = f"(CASE WHEN {d(name)} % 100 < {noise} THEN ({d('v')} % 10 + 5) % 10 ELSE {d('v')} % 10 END)"
        return f"CASE WHEN {moved} <= 6 THEN 'supported' WHEN {moved} <= 8 THEN 'unsupported' ELSE 'contradicted' END AS {name}"

    return f"""answered AS (SELECT t.*, u.claim::BIGINT AS claim FROM traces t, UNNEST(range(1, (t.n_claims + 1)::BIGINT)) u(claim) WHERE status IN ('answered', 'partial')),
rated AS (SELECT *, CASE WHEN {d('ck')} % 10 <= 6 THEN 'document' WHEN {d('ck')} % 10 <= 8 THEN 'context' ELSE 'general' END AS kind, {rater('judge', 0)}, {rater('second', 15)}, {rater('retest', 4)}, {rater('human', 25)}, {d('sb')} % 32 AS bits FROM answered),
claims AS (SELECT *, CASE WHEN judge = 'supported' THEN bits ELSE 0 END AS support_bits FROM rated)"""


CLAIMS_SQL = TRACES_SQL + ",\n" + _claims_sql()
CLAIMS_RUNS_SQL = RUNS_SQL + ",\n" + _claims_sql()

ARM = ("condition", "model", "prompt")


def grounded(c: DataFrame) -> DataFrame:
    """Per trace: document claims and what the judge says of them; a share only where there are document claims."""
    doc = F.col("kind") == "document"
    of = lambda verdict: F.count_if(doc & (F.col("judge") == verdict))
    g = c.groupBy("trace_id").agg(
        F.count("*").alias("n_claims"), F.count_if(doc).alias("n_document"), of("supported").alias("n_supported"), of("unsupported").alias("n_unsupported"), of("contradicted").alias("n_contradicted"),
        F.count_if((F.col("kind") == "context") & (F.col("judge") == "contradicted")).alias("n_context_contradicted"),
    )
    some = F.col("n_document") > 0
    return g.select("*", F.when(some, F.col("n_supported") / F.col("n_document")).alias("groundedness"), F.when(some, F.col("n_supported") == F.col("n_document")).alias("fully_grounded"))


GROUNDED_SQL = """grounded AS (SELECT *, CASE WHEN n_document > 0 THEN n_supported / n_document END AS groundedness, CASE WHEN n_document > 0 THEN n_supported = n_document END AS fully_grounded
FROM (SELECT trace_id, count(*) AS n_claims, count_if(kind = 'document') AS n_document, count_if(kind = 'document' AND judge = 'supported') AS n_supported,
  count_if(kind = 'document' AND judge = 'unsupported') AS n_unsupported, count_if(kind = 'document' AND judge = 'contradicted') AS n_contradicted,
  count_if(kind = 'context' AND judge = 'contradicted') AS n_context_contradicted FROM claims GROUP BY trace_id))"""
