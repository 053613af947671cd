"""Queries of agreement with intervals: kappas, their differences, and the handling of false premises by two raters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import resampling as S
from ..registry import query
from .draws import RESAMPLES, draws_sql, seeds_sql
from .evaluation_queries import r6
from .evaluation_tables import CLAIMS_SQL, TRACES_SQL, claims, draw, sql_draw, traces

#: How an answer may treat a question's false premise.
HANDLINGS = ("rejects_premise", "accepts_premise", "declines_without_addressing")


def counts_sql(name: str, seed: int, pairs: str, by: str) -> str:
    """CTEs that end in ``name``: kappa of the columns a and b of every group in each resample of the questions of ``pairs``."""
    weight = " + ".join(f"(drawn >= {bar})::INT" for bar in S.POISSON)
    n = name
    return f"""{n}u AS (SELECT DISTINCT question_id, ('0x' || substr(md5(question_id::VARCHAR), 1, 8))::UBIGINT AS h FROM {pairs}), {draws_sql(f'{n}d', f'(SELECT question_id, h, b, s FROM {n}u, seeded{seed})', 'xor(s, h)', 'question_id, b')},
{n}w AS (SELECT question_id, b AS rep, {weight} AS w FROM {n}d), {n}c AS (SELECT {by}, question_id, a, b, count(*) AS c FROM {pairs} WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
{n}s AS (SELECT {by}, rep, a, b, sum(w * c)::DOUBLE AS c FROM {n}c JOIN {n}w USING (question_id) GROUP BY ALL),
{n}t AS (SELECT {by}, rep, sum(c) AS n, sum(CASE WHEN a = b THEN c ELSE 0 END) AS same FROM {n}s GROUP BY ALL),
{n}l AS (SELECT {by}, rep, l, sum(ca) AS ca, sum(cb) AS cb FROM (SELECT {by}, rep, a AS l, c AS ca, 0 AS cb FROM {n}s UNION ALL SELECT {by}, rep, b, 0, c FROM {n}s) GROUP BY ALL),
{n}p AS (SELECT {by}, rep, sum(ca * cb) AS met FROM {n}l GROUP BY ALL),
{name} AS (SELECT {by}, rep, CASE WHEN n > 0 AND met / (n * n) < 1 - 1e-12 THEN (same / n - met / (n * n)) / (1 - met / (n * n)) END AS kappa FROM {n}t JOIN {n}p USING ({by}, rep))"""


def seeded(seed: int) -> str:
    return seeds_sql(seed).replace("seeded AS", f"seeded{seed} AS").replace("sd1", f"sd{seed}a").replace("sd2", f"sd{seed}b").replace("FROM sd)", f"FROM sd{seed})").replace("sd AS", f"sd{seed} AS")


def whole_sql(name: str, pairs: str, by: str) -> str:
    """CTEs that end in ``name``: n, agreement and kappa of the columns a and b by group."""
    n = name
    return f"""{n}0 AS (SELECT {by}, count(*) AS n, avg((a = b)::INT) AS po FROM {pairs} WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY {by}),
{n}1 AS (SELECT {by}, sum(ca * cb) AS met FROM (SELECT {by}, l, sum(ca) AS ca, sum(cb) AS cb FROM (SELECT {by}, a AS l, 1 AS ca, 0 AS cb FROM {pairs} WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT {by}, b, 0, 1 FROM {pairs} WHERE a IS NOT NULL AND b IS NOT NULL) GROUP BY ALL) GROUP BY {by}),
{name} AS (SELECT {by}, n, po AS agreement, CASE WHEN met / (n * n) < 1 THEN (po - met / (n * n)) / (1 - met / (n * n)) END AS kappa FROM {n}0 JOIN {n}1 USING ({by}))"""


_RATERS = (("judge", "second"), ("judge", "retest"), ("judge", "human"), ("second", "human"))
_PAIRS_SQL = "pairs AS (" + " UNION ALL ".join(f"SELECT '{a}_{b}' AS pair, question_id, {a} AS a, {b} AS b FROM claims" for a, b in _RATERS) + ")"


@query("kappa_intervals", f"""WITH {CLAIMS_SQL}, {_PAIRS_SQL}, {seeded(41)}, {whole_sql('k', 'pairs', 'pair')}, {counts_sql('r', 41, 'pairs', 'pair')}
SELECT k.pair, k.n, round(k.kappa, 6) AS kappa, round(quantile_cont(r.kappa, 0.025), 6) AS lo, round(quantile_cont(r.kappa, 0.975), 6) AS hi FROM k JOIN r USING (pair) GROUP BY k.pair, k.n, k.kappa""")
def kappa_intervals(spark, sf):
    """Kappa of four pairs of raters with bootstrap intervals; a question's claims are drawn together."""
    pair = F.explode(F.array(*[F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in _RATERS])).alias("p")
    p = claims(spark, sf).select("question_id", pair).select("question_id", "p.*")
    whole = A.cohen_kappa(p, "a", "b", ["pair"])
    interval = S.percentile_interval(S.resample_kappas(p, "a", "b", "question_id", ["pair"], 41, RESAMPLES), ["pair"])
    return whole.join(interval, "pair").select("pair", "n", r6("kappa").alias("kappa"), r6("lo").alias("lo"), r6("hi").alias("hi"))


_SUBSETS_SQL = "subsets AS (SELECT 'all' AS subset, question_id, judge, second, human FROM claims UNION ALL SELECT kind, question_id, judge, second, human FROM claims)"


@query("kappa_difference", f"""WITH {CLAIMS_SQL}, {_SUBSETS_SQL}, pj AS (SELECT subset, question_id, judge AS a, human AS b FROM subsets), ps AS (SELECT subset, question_id, second AS a, human AS b FROM subsets), {seeded(43)},
{whole_sql('kj', 'pj', 'subset')}, {whole_sql('ks', 'ps', 'subset')}, {counts_sql('rj', 43, 'pj', 'subset')}, {counts_sql('rs', 43, 'ps', 'subset')},
i AS (SELECT rj.subset, quantile_cont(rj.kappa - rs.kappa, 0.025) AS lo, quantile_cont(rj.kappa - rs.kappa, 0.975) AS hi FROM rj JOIN rs USING (subset, rep) GROUP BY 1)
SELECT kj.subset, kj.n, round(kj.kappa, 6) AS kappa_judge, round(ks.kappa, 6) AS kappa_external, round(kj.kappa - ks.kappa, 6) AS difference, round(i.lo, 6) AS lo, round(i.hi, 6) AS hi FROM kj JOIN ks USING (subset) JOIN i USING (subset)""")
def kappa_difference(spark, sf):
    """How much better the judge agrees with the human labels than an external rater does, on all claims and by kind; both kappas of a resample have the same weights."""
    subset = F.explode(F.array(F.lit("all"), F.col("kind"))).alias("subset")
    c = claims(spark, sf).select(subset, "question_id", "human", "judge", "second")
    # Both raters in one pass: a group is a subset and a rater.
    rater = F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("a")) for r in ("judge", "second")])).alias("p")
    p = c.select("subset", "question_id", "human", rater).select("subset", "question_id", "human", "p.*")
    by = ["subset", "rater"]
    whole = A.cohen_kappa(p, "a", "human", by)
    of = lambda df, r, c, name: df.filter(F.col("rater") == r).select("subset", *(["b"] if "b" in df.columns else []), F.col(c).alias(name), *(["n"] if "n" in df.columns and r == "judge" else []))
    drawn = S.resample_kappas(p, "a", "human", "question_id", by, 43, RESAMPLES)
    differences = drawn.groupBy("subset", "b").agg((F.max(F.when(F.col("rater") == "judge", F.col("mean"))) - F.max(F.when(F.col("rater") == "second", F.col("mean")))).alias("mean"))
    both = of(whole, "judge", "kappa", "kappa_judge").join(of(whole, "second", "kappa", "kappa_external"), "subset")
    out = both.join(S.percentile_interval(differences, ["subset"]), "subset")
    return out.select("subset", "n", r6("kappa_judge").alias("kappa_judge"), r6("kappa_external").alias("kappa_external"), r6(F.col("kappa_judge") - F.col("kappa_external")).alias("difference"), r6("lo").alias("lo"), r6("hi").alias("hi"))


def _noisy_sql() -> str:
    keys = "'{t}', trace_id"
    d = lambda t: f"('0x' || substr(md5(concat_ws('|', {keys.format(t=t)})), 1, 8))::BIGINT"
    name = lambda x: f"['{HANDLINGS[0]}', '{HANDLINGS[1]}', '{HANDLINGS[2]}'][({x}) + 1]"
    return f"""premises AS (SELECT trace_id, question_id, model, prompt, {name(f"{d('pj')} % 3")} AS judge, {name(f"CASE WHEN {d('pn')} % 4 = 0 THEN {d('ph')} % 3 ELSE {d('pj')} % 3 END")} AS human,
{d('ps')} % 3 = 0 AS saw_judge, {d('pr')} % 5 = 0 AS by_rule FROM traces WHERE question_id % 4 = 3)"""


def premises(spark, sf):
    """Traces of questions with a false premise: how the judge and a person say it is handled, whether the person saw the judge's label, whether a rule decided."""
    t = traces(spark, sf).filter("question_id % 4 = 3")
    name = lambda k: F.get(F.array(*[F.lit(h) for h in HANDLINGS]), k.cast("int"))
    d = lambda tag: draw(tag, "trace_id")
    human = F.when(d("pn") % 4 == 0, d("ph") % 3).otherwise(d("pj") % 3)
    return t.select("trace_id", "question_id", "model", "prompt", name(d("pj") % 3).alias("judge"), name(human).alias("human"), (d("ps") % 3 == 0).alias("saw_judge"), (d("pr") % 5 == 0).alias("by_rule"))


@query("q4_premise", f"""WITH {TRACES_SQL}, {_noisy_sql()}, v AS (SELECT model, 'human' AS rater, question_id, human AS handling FROM premises UNION ALL SELECT model, 'judge', question_id, judge FROM premises),
u AS (SELECT model, rater, question_id, count_if(handling = 'rejects_premise')::BIGINT AS total, count(*) AS weight FROM v GROUP BY ALL), {seeds_sql(47)}, un AS (SELECT *, ('0x' || substr(md5(question_id::VARCHAR), 1, 8))::UBIGINT AS h FROM u),
{draws_sql('dw', '(SELECT un.*, b, s FROM un, seeded)', 'xor(s, h)', 'model, rater, b, total, weight')}, rep AS (SELECT model, rater, b, sum(w * total) / nullif(sum(w * weight), 0) AS mean FROM (SELECT *, {" + ".join(f"(drawn >= {bar})::INT" for bar in S.POISSON)} AS w FROM dw) GROUP BY ALL),
i AS (SELECT model, rater, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM rep GROUP BY ALL)
SELECT v.model, v.rater, count(*) AS n, count_if(handling = 'rejects_premise')::BIGINT AS rejects, count_if(handling = 'accepts_premise')::BIGINT AS accepts, count_if(handling = 'declines_without_addressing')::BIGINT AS declines, round(avg((handling = 'rejects_premise')::INT), 6) AS rejected, round(max(lo), 6) AS lo, round(max(hi), 6) AS hi FROM v JOIN i USING (model, rater) GROUP BY ALL""")
def q4_premise(spark, sf):
    """How false premises are handled by model, as each rater has it; the rejected share with its interval over questions."""
    rater = F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("handling")) for r in ("human", "judge")])).alias("p")
    v = premises(spark, sf).select("model", "question_id", rater).select("model", "question_id", "p.*")
    by, rejects = ["model", "rater"], F.col("handling") == HANDLINGS[0]
    u = v.groupBy(*by, "question_id").agg(F.count_if(rejects).alias("total"), F.count("*").alias("weight"))
    of = lambda h: F.count_if(F.col("handling") == h)
    whole = v.groupBy(*by).agg(F.count("*").alias("n"), of(HANDLINGS[0]).alias("rejects"), of(HANDLINGS[1]).alias("accepts"), of(HANDLINGS[2]).alias("declines"), r6(F.avg(rejects.cast("int"))).alias("rejected"))
    interval = S.percentile_interval(S.resample_means(u, "question_id", by, 47, RESAMPLES), by)
    return whole.join(interval, by).select(*whole.columns, r6("lo").alias("lo"), r6("hi").alias("hi"))


_LABELLED_SQL = "labelled AS (SELECT 'all_labelled' AS labels, question_id, human AS a, judge AS b FROM premises WHERE NOT by_rule UNION ALL SELECT 'blind', question_id, human, judge FROM premises WHERE NOT by_rule AND NOT saw_judge), flags AS (SELECT labels, question_id, (a = 'rejects_premise')::VARCHAR AS a, (b = 'rejects_premise')::VARCHAR AS b FROM labelled)"


@query("q4_premise_agreement", f"""WITH {TRACES_SQL}, {_noisy_sql()}, {_LABELLED_SQL}, {seeded(53)}, {whole_sql('k', 'labelled', 'labels')}, {whole_sql('f', 'flags', 'labels')}, {counts_sql('r', 53, 'labelled', 'labels')}
SELECT k.labels, k.n, round(k.agreement, 6) AS raw_agreement, round(k.kappa, 6) AS kappa, round(f.kappa, 6) AS kappa_rejects, round(quantile_cont(r.kappa, 0.025), 6) AS lo, round(quantile_cont(r.kappa, 0.975), 6) AS hi FROM k JOIN f USING (labels) JOIN r USING (labels) GROUP BY k.labels, k.n, k.agreement, k.kappa, f.kappa""")
def q4_premise_agreement(spark, sf):
    """Person against judge on premises: only labels made without sight of the judge's (blind), and all; rows that a rule decided agree by construction and stay out."""
    labels = F.explode(F.when(F.col("saw_judge"), F.array(F.lit("all_labelled"))).otherwise(F.array(F.lit("all_labelled"), F.lit("blind")))).alias("labels")
    p = premises(spark, sf).filter("NOT by_rule").select(labels, "question_id", "human", "judge")
    rejects = lambda c: F.col(c) == HANDLINGS[0]
    flags = A.cohen_kappa(p.select("labels", rejects("human").alias("human"), rejects("judge").alias("judge")), "human", "judge", ["labels"])
    interval = S.percentile_interval(S.resample_kappas(p, "human", "judge", "question_id", ["labels"], 53, RESAMPLES), ["labels"])
    whole = A.cohen_kappa(p, "human", "judge", ["labels"]).join(flags.select("labels", F.col("kappa").alias("rejects")), "labels").join(interval, "labels")
    return whole.select("labels", "n", r6("agreement").alias("raw_agreement"), r6("kappa").alias("kappa"), r6("rejects").alias("kappa_rejects"), r6("lo").alias("lo"), r6("hi").alias("hi"))
