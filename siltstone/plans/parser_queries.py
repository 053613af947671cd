"""Queries of the sequential table functions (parsers); SQL cannot express them, tests hold them against small cases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import figures as G
from ..functions import outputs as O
from ..registry import query, table
from ..sources.html import document_kind, html_blocks
from .evaluation_tables import CLAIMS_SQL, claims


@query("html_blocks")
def html_block_scan(spark, sf):
    return html_blocks(table(spark, sf, "pages"))


@query("html_block_stats")
def html_block_stats(spark, sf):
    b = html_blocks(table(spark, sf, "pages"))
    return b.groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.max("page").alias("pages"), F.countDistinct("section").alias("sections"), F.count_if("is_table").alias("tables"), F.max("char_end").alias("n_chars"))


@query("document_dispatch", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'pdf' ELSE 'html' END AS kind FROM pages")
def document_dispatch(spark, sf):
    name = F.when(F.col("page_id") % 4 == 0, "a.PDF").when(F.col("page_id") % 4 == 1, "a.htm").otherwise("a.bin")
    return table(spark, sf, "pages").select("page_id", document_kind(name, F.col("html")).alias("kind"))


@query("figure_extract")
def figure_extract(spark, sf):
    return G.extract(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.explode("figures").alias("f")).select("doc_id", "f.*")


#: Bisection of the binomial tails: sixty halvings for each bound.
_TAIL = "(SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))) FROM range({first}, {last}) t(i))"


@query("clopper_pearson", f"""WITH RECURSIVE {CLAIMS_SQL}, g AS (SELECT model, prompt, count_if(judge = 'supported')::BIGINT AS k, count(*)::BIGINT AS n FROM claims GROUP BY ALL),
lo(model, prompt, k, n, step, a, z) AS (SELECT model, prompt, k, n, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM g UNION ALL SELECT model, prompt, k, n, step + 1, CASE WHEN s > 0.025 THEN a ELSE p END, CASE WHEN s > 0.025 THEN p ELSE z END
 FROM (SELECT *, {_TAIL.format(first='k', last='n + 1')} AS s FROM (SELECT *, (a + z) / 2 AS p FROM lo WHERE step < 60))),
hi(model, prompt, k, n, step, a, z) AS (SELECT model, prompt, k, n, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM g UNION ALL SELECT model, prompt, k, n, step + 1, CASE WHEN s > 0.025 THEN p ELSE a END, CASE WHEN s > 0.025 THEN z ELSE p END
 FROM (SELECT *, {_TAIL.format(first='0', last='k + 1')} AS s FROM (SELECT *, (a + z) / 2 AS p FROM hi WHERE step < 60)))
SELECT g.model, g.prompt, g.k, g.n, CASE WHEN g.k = 0 THEN 0 ELSE round(lo.a, 6) END::DOUBLE AS lo, CASE WHEN g.k = g.n THEN 1 ELSE round(hi.a, 6) END::DOUBLE AS hi FROM g JOIN lo ON lo.model = g.model AND lo.prompt = g.prompt AND lo.step = 60 JOIN hi ON hi.model = g.model AND hi.prompt = g.prompt AND hi.step = 60""")
def clopper_pearson(spark, sf):
    """Exact intervals of each model's share of supported claims; a row per group, so the solver sees a few rows."""
    g = claims(spark, sf).groupBy("model", "prompt").agg(F.count_if(F.col("judge") == "supported").alias("k"), F.count("*").alias("n"))

    def run(frames):
        for f in frames:
            found = [G.clopper_pearson(int(k), int(n)) or (None, None) for k, n in zip(f.k, f.n, strict=True)]
            yield pd.DataFrame({"model": f.model, "prompt": f.prompt, "k": f.k, "n": f.n, "lo": [round(a, 6) for a, _ in found], "hi": [round(b, 6) for _, b in found]})

    return g.mapInPandas(run, "model string, prompt string, k long, n long, lo double, hi double")


#: Outputs written around a turn, by (conv_id + turn) % 8.
_OUTPUT_FORMS = ("REASONING: r\nANSWER: {t}\nCITATIONS: C1, C{n}\nCONFIDENCE: {c}", "**Answer:** **{t}**\n## citations: [c1], C{n}, C1\n_Confidence_: {c} / 100", "preamble\nANSWER: first\nANSWER: {t}\nCITATIONS: NONE\nCONFIDENCE: {c}%",
                 "ANSWER: {t}\nCITATIONS: CONFIDENCE: {c}", "NOT_IN_DOCUMENTS", "ANSWER: *not in documents*\nCITATIONS: some pages\nCONFIDENCE: high", "ANSWER: {t}\nCITATIONS: C{n}\nCONFIDENCE: {c}\nmore", "ANSWER:\nCONFIDENCE: {c}")


@query("output_parse", """WITH b AS (SELECT conv_id, turn, (conv_id + turn) % 8 AS k, turn + 3 AS n, conv_id % 120 AS c FROM conversations)
SELECT conv_id, turn, CASE WHEN k IN (4, 7) THEN 'failed' WHEN k IN (3, 5) OR c > 100 THEN 'partial' ELSE 'ok' END AS status, CASE WHEN k NOT IN (4, 5, 7) AND c <= 100 THEN c END::INT AS confidence,
CASE WHEN k IN (0, 1) THEN CASE WHEN n BETWEEN 2 AND 5 THEN 2 ELSE 1 END WHEN k = 6 THEN (n BETWEEN 1 AND 5)::INT ELSE 0 END::INT AS n_citations, CASE WHEN k IN (0, 1, 6) THEN (n > 5)::INT ELSE 0 END::INT AS n_invalid, k IN (4, 5) AS abstained,
CASE k WHEN 3 THEN 'empty_citations_chained' WHEN 4 THEN 'missing_answer' WHEN 5 THEN 'citations_unparseable,confidence_unparseable' WHEN 7 THEN 'missing_answer'
ELSE array_to_string(list_filter([CASE WHEN k = 2 THEN 'duplicate_answer' END, CASE WHEN k = 2 THEN 'text_before_first_field' END, CASE WHEN k IN (0, 1, 6) AND n > 5 THEN 'citation_out_of_range' END, CASE WHEN c > 100 THEN 'confidence_unparseable' END, CASE WHEN k = 6 THEN 'text_after_confidence' END], lambda x: x IS NOT NULL), ',') END
|| CASE WHEN k = 3 AND c > 100 THEN ',confidence_unparseable' ELSE '' END AS issues FROM b""")
def output_parse(spark, sf):
    """Conversation turns written as model output in eight forms and parsed again."""
    c = table(spark, sf, "conversations")
    raw = F.get(F.array(*[F.lit(f) for f in _OUTPUT_FORMS]), ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    # The turn's own words must not hold a label at the beginning of a line.
    words = F.concat(F.lit("it says "), F.regexp_replace("text", "[*_\\s]+", " "))
    for name, value in (("{n}", (F.col("turn") + 3).cast("string")), ("{c}", (F.col("conv_id") % 120).cast("string")), ("{t}", words)):
        raw = F.replace(raw, F.lit(name), value)

    def run(frames):
        for f in frames:
            p = [O.parse_output(t, 5, ("REASONING", "ANSWER", "CITATIONS", "CONFIDENCE") if t.startswith("REASONING") else ("ANSWER", "CITATIONS", "CONFIDENCE")) for t in f.raw]
            yield pd.DataFrame({"conv_id": f.conv_id, "turn": f.turn, "status": [x["status"] for x in p], "confidence": [x["confidence"] for x in p], "n_citations": [len(x["citations"]) for x in p], "n_invalid": [len(x["invalid_citations"]) for x in p], "abstained": [x["abstained"] for x in p], "issues": [",".join(x["issues"]) for x in p]}).astype({"confidence": "Int64"})

    return c.select("conv_id", "turn", raw.alias("raw")).mapInPandas(run, "conv_id long, turn long, status string, confidence int, n_citations int, n_invalid int, abstained boolean, issues string")


@query("quote_fidelity")
def quote_fidelity(spark, sf):
    """Quotes of every document: each of its lines, its longest line with two letters put in, and words that nobody wrote."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(frames):
        for f in frames:
            rows = []
            for doc_id, text in zip(f.doc_id, f.text, strict=True):
                lines = text.split("\n")
                long = max(lines, key=len)
                quotes = [{"label": 1, "text": t} for t in (*lines, long[: len(long) // 2] + "zq" + long[len(long) // 2 :], "words that nobody wrote in any of them")]
                r = O.quote_fidelity(quotes, {1: text})
                rows.append((doc_id, r["n_quotes"], ",".join(sorted(set(r["states"]))), r["faithful_rate"], r["exact_rate"]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_quotes", "states", "faithful_rate", "exact_rate"])

    return d.mapInPandas(run, "doc_id long, n_quotes int, states string, faithful_rate double, exact_rate double")


#: Answers to a gold of X (or of minus X) in thousands, by o_orderkey % 8; m is X in millions, k a thousand times X, d twice X.
_GRADED = ("Sales were ${x:,} thousand (up 3.5%).", "Sales were ${m:.3f} million.", "It was ${k}.", "It was ${x} million.", "It was ${d}.", "There were none at all.", "It declined by ${x:,} thousand.", "It was ${x:,} thousand, as (5) says.")


_GRADED_SQL = """o AS (SELECT o_orderkey, o_orderkey % 8 AS k, floor(o_totalprice)::BIGINT + 1000 AS x FROM orders),
figs AS (SELECT *, CASE k WHEN 0 THEN [{'a': x::DOUBLE, 'f': 1e3, 's': false}, {'a': 3.5, 'f': NULL, 's': true}] WHEN 1 THEN [{'a': x / 1000.0, 'f': 1e6, 's': false}] WHEN 2 THEN [{'a': x * 1000.0, 'f': NULL, 's': false}]
  WHEN 3 THEN [{'a': x::DOUBLE, 'f': 1e6, 's': false}] WHEN 4 THEN [{'a': 2.0 * x, 'f': NULL, 's': false}] WHEN 5 THEN []::STRUCT(a DOUBLE, f DOUBLE, s BOOLEAN)[] WHEN 6 THEN [{'a': x::DOUBLE, 'f': 1e3, 's': false}]
  ELSE [{'a': x::DOUBLE, 'f': 1e3, 's': false}, {'a': 5.0, 'f': NULL, 's': false}] END::STRUCT(a DOUBLE, f DOUBLE, s BOOLEAN)[] AS figs FROM o),
f AS (SELECT o_orderkey, k = 6 AS falling, CASE WHEN k >= 6 THEN -x ELSE x END::DOUBLE AS gold, u.i, figs[u.i::BIGINT] AS g FROM figs, UNNEST(range(1, len(figs) + 1)) u(i)),
r AS (SELECT *, CASE WHEN g.s THEN [g.a / 100 / 1e3] WHEN g.f IS NOT NULL THEN [g.a * g.f / 1e3] ELSE [g.a, g.a / 1e3] END AS r FROM f)"""


def _grade_sql(tolerance: float) -> str:
    """Number of the grade of readings r, from 0 (correct) to 2 (incorrect)."""
    near = lambda y: f"abs({y} - gold) <= greatest({tolerance} * abs(gold), 0.5) * (1 + 1e-9) + 1e-12"
    some = lambda test: f"len(list_filter(r, lambda y: {test})) > 0"
    factors = ", ".join(f"{k!r}::DOUBLE" for k in G.UNIT_FACTORS)
    unit = some(f"len(list_filter([{factors}], lambda q: ({near('y * q')}) OR (gold < 0 AND y > 0 AND {near('-y * q')}))) > 0")
    return f"CASE WHEN {some(near('y'))} THEN 0 WHEN falling AND gold < 0 AND {some('y > 0 AND ' + near('-y'))} THEN 0 WHEN {unit} THEN 1 ELSE 2 END"


_TURNED = "len(list_filter(r, lambda y: y <> 0 AND abs(-y - gold) <= greatest(0.01 * abs(gold), 0.5) * (1 + 1e-9) + 1e-12)) > 0"
_DIRECT = "len(list_filter(r, lambda y: abs(y - gold) <= greatest(0.01 * abs(gold), 0.5) * (1 + 1e-9) + 1e-12)) > 0"


@query("numeric_grade", f"""WITH {_GRADED_SQL}, m AS (SELECT *, {_grade_sql(0.01)} AS grade, {_grade_sql(0.1)} AS wide FROM r),
p AS (SELECT o_orderkey, arg_min(grade, i) AS main, min(grade) AS best, arg_min(wide, i) AS wide, count(*) AS n, arg_min(CASE WHEN {_DIRECT} THEN '' WHEN falling AND grade = 0 THEN 'sign_in_words' WHEN grade = 2 AND {_TURNED} THEN 'sign_mismatch' ELSE '' END, i) AS sign FROM m GROUP BY 1)
SELECT o.o_orderkey, ['correct', 'unit_error', 'incorrect'][p.main + 1] AS label, ['correct', 'unit_error', 'incorrect'][p.best + 1] AS any_label, nullif(p.sign, '') AS sign, coalesce(p.n, 0)::INT AS n_figures, ['correct', 'unit_error', 'incorrect'][p.wide + 1] AS at_ten_percent FROM o LEFT JOIN p USING (o_orderkey)""")
def numeric_grade(spark, sf):
    """Gold answers and answers about every order's price, graded from their texts."""

    def run(frames):
        for f in frames:
            rows = []
            for key, price in zip(f.o_orderkey, f.x, strict=True):
                x, k = int(price) + 1000, int(key) % 8
                gold = G.gold_figure(f"{'-' * (k >= 6)}${x:,}.00", "What is the total in USD thousands? Round to zero decimal places.")
                g = G.grade_numeric(_GRADED[k].format(x=x, m=x / 1000, k=x * 1000, d=2 * x), gold)
                rows.append((key, g["label"], g["any_label"], g["sign"], g["n_figures"], g["sensitivity"][0.1]))
            yield pd.DataFrame(rows, columns=["o_orderkey", "label", "any_label", "sign", "n_figures", "at_ten_percent"])

    return table(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").alias("x")).mapInPandas(run, "o_orderkey long, label string, any_label string, sign string, n_figures int, at_ten_percent string")


_HELD = """len(list_filter(v, lambda y: len(list_filter([0, 3, 6, 9, -3, -6, -9], lambda p: (p = 0 OR digits >= 3) AND y >= (a - slack) * pow(10.0, p) AND y <= (a + slack) * pow(10.0, p))) > 0)) > 0"""


@query("numeric_support", f"""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, floor(o_totalprice)::BIGINT + 1000 AS x FROM orders),
mine AS (SELECT o_orderkey, k, x, u.m.a AS a, u.m.digits AS digits, 0.5 * pow(10.0, -u.m.places) * (1 + 1e-9) + 1e-12 AS slack FROM o, UNNEST([{{'a': x::DOUBLE, 'digits': length(x::VARCHAR), 'places': 0}}, {{'a': 12.5::DOUBLE, 'digits': 3, 'places': 1}}, {{'a': 7.0::DOUBLE, 'digits': 1, 'places': 0}}]) u(m) WHERE k <> 3 AND u.m.digits >= 2),
texts AS (SELECT *, CASE WHEN k = 2 THEN [2.0 * x, 12.5] ELSE [x / 1000.0, 12.46] END::DOUBLE[] AS v FROM mine),
h AS (SELECT o_orderkey, {_HELD} AS held, k <> 1 AS cites FROM texts),
s AS (SELECT o_orderkey, count(*) AS n, count(*) FILTER (held AND cites) AS here, count(*) FILTER (held) AS anywhere, bool_or(cites) AS cites FROM h GROUP BY 1)
SELECT o.o_orderkey, coalesce(s.n, 0)::INT AS n_figures, coalesce(s.here, 0)::INT AS n_in_cited, coalesce(s.anywhere, 0)::INT AS n_in_context, CASE WHEN s.cites THEN s.here / s.n END::DOUBLE AS in_cited_rate, (s.anywhere / s.n)::DOUBLE AS in_context_rate FROM o LEFT JOIN s USING (o_orderkey)""")
def numeric_support(spark, sf):
    """Answers with a price and a share against texts that hold them: scaled and rounded, elsewhere, in part, or no figures at all."""

    def run(frames):
        for f in frames:
            rows = []
            for key, price in zip(f.o_orderkey, f.x, strict=True):
                x, k = int(price) + 1000, int(key) % 4
                table_row = f"Total {x / 1000:.3f} against 12.46 % before"
                cited, context = {0: ([table_row], [table_row]), 1: ([], [table_row]), 2: ([f"Total {x * 2}, share 12.5"], [f"Total {x * 2}, share 12.5"]), 3: ([table_row], [table_row])}[k]
                s = G.support("none of 5" if k == 3 else f"It was ${x:,}, or 12.5% of all 7.", cited, context)
                rows.append((key, s["n_figures"], s["n_in_cited"], s["n_in_context"], s["in_cited_rate"], s["in_context_rate"]))
            yield pd.DataFrame(rows, columns=["o_orderkey", "n_figures", "n_in_cited", "n_in_context", "in_cited_rate", "in_context_rate"])

    return table(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").alias("x")).mapInPandas(run, "o_orderkey long, n_figures int, n_in_cited int, n_in_context int, in_cited_rate double, in_context_rate double")
