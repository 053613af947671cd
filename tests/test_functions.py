"""Small cases with known answers for the functions and operators of the engine."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import figures as G
from siltstone.functions import outputs as O
from siltstone.functions import text as T
from siltstone.operators import agreement as A
from siltstone.operators import chunking as C
from siltstone.operators import retrieval as R
from siltstone.sources import html as H


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("FY2020 sales 2,345 and 7,8 (3.5%)"))) == ["fy", "2020", "sales", "2345", "and", "7", "8", "3.5"]


def test_find_all(spark):
    assert one(spark, T.find_all(F.lit("aaaa"), "aa")) == [0, 1, 2]
    assert one(spark, T.find_all(F.lit("xaby"), "ab")) == [1]
    assert one(spark, T.find_all(F.lit("x"), "ab")) == []


def test_normalise(spark):
    assert one(spark, T.normalise(F.lit("A-1,000.5\n"))) == "a10005"


@pytest.mark.parametrize("text, want", [("$2,500 million", (2500, 1e6, False, True)), ("up 25 bps", (0.25, 1.0, True, False)), ("3.1x", (3.1, 1.0, False, False)), ("(12.0%)", (12.0, 1.0, True, False)), ("$6,489M", (6489, 1e6, False, True))])
def test_figure(text, want):
    (f,) = G.figures(text)
    assert (f.amount, f.factor or 1.0, f.share, f.money) == want


@pytest.mark.parametrize("text", ["December 31, 2021", "10-K", "3M sold", "12 months ended", "in 2020", "", None])
def test_no_figure(text):
    assert G.figures(text) == []


@pytest.mark.parametrize("text, want", [("a-5 and 10-5", [5, 10, 5]), ("-$5, $-6, - 7, \u22128", [-5, -6, -7, -8]), ("US$5, USD 6, a$7", [5, 6]), ("1.2.3 or v1,000", [1.2]), ("1,234,567.89 dollars", [1234567.89]), ("2nd, 4Q, C3, 5million", []), ("5 per cent, 6 %, 7 pct, 8 percentage points", [5, 6, 7, 8]), ("May 5, Sept. 6, 7 weeks, 8-month, 61.33 days", [61.33]), ("$2,020 in 2021 or 2,022", [2020, 2022])])
def test_figures_of_a_sentence(text, want):
    assert [f.amount for f in G.figures(text)] == want


def test_gold():
    assert G.gold_figure("$1577.00", "in USD millions, rounded to one decimal") == (1577.0, 1e6, "currency", 1)
    assert G.gold_figure("12.5%") == (12.5, 1.0, "percent", 1) and G.gold_figure("0.66 increase now", "as a percentage").kind == "percent"
    assert G.gold_figure("one 5 and 6") is None and G.gold_figure("it rose by 5 or so they say") is None and G.gold_figure("none") is None


@pytest.mark.parametrize("answer, kind, want", [("It was (3.5) so a = 7.25 in all.", "plain", 7.25), ("24.26 (revenue of $6,489M). More 5.", "plain", 24.26), ("$19,815M - $13,997M = $5,818M", "currency", 5818), ("About 5. Then = 6 and 7", "plain", 5), ("It grew 8% to $9", "currency", 9), ("It grew 8%. Yes", "plain", 8), ("only (4.5)", "plain", 4.5), ("just 3.5%", "currency", 3.5)])
def test_primary(answer, kind, want):
    assert G.primary(answer, kind).amount == want


@pytest.mark.parametrize("answer, gold, want", [("$1.5 billion", (1500, 1e6, "currency", 2), ("correct", None)), ("1,500", (1500, 1e6, "currency", 2), ("correct", None)), ("$1,500,000", (1500, 1e6, "currency", 2), ("unit_error", None)), ("$1,600 million", (1500, 1e6, "currency", 2), ("incorrect", None)),
                                                ("declined by 0.02", (-0.02, 1, "plain", 2), ("correct", "sign_in_words")), ("0.02", (-0.02, 1, "plain", 2), ("incorrect", "sign_mismatch")), ("$0.3 million", (0, 1, "plain", 2), ("incorrect", None)), ("0.125", (12.5, 1, "percent", 1), ("correct", None)),
                                                ("up 25 bps", (0.25, 1, "percent", 2), ("correct", None)), ("68%", (0.68, 1, "plain", 2), ("correct", None)), ("none", (1, 1, "plain", 0), (None, None))])
def test_grade(answer, gold, want):
    g = G.grade_numeric(answer, G.Gold(*gold))
    assert (g["label"], g["sign"]) == want
    if answer == "$1,600 million":
        assert g["sensitivity"] == {0.01: "incorrect", 0.05: "incorrect", 0.1: "correct"}


def test_support():
    assert G.support("It rose 12.5 and 3", ["12.5 was seen"], ["12.5 was seen"])["in_cited_rate"] == 1.0
    assert G.support("$7.45 billion", ["7,453"], [])["n_in_cited"] == 1 and G.support("7.4 billion", ["7,453"], [])["n_in_cited"] == 0
    assert G.support("12.5 and 13.5", [], ["12.46"]) == {"n_figures": 2, "n_in_cited": 0, "n_in_context": 1, "in_cited_rate": None, "in_context_rate": 0.5}
    assert G.support("none", [], [])["in_context_rate"] is None


@pytest.mark.parametrize("text, want", [("The context provided does not really disclose it", True), ("the filings did mention it", False), ("It is not explicitly stated in any of the provided documents", True), ("cannot be accurately determined", True), ("We can't answer", True), ("not enough of the data", True),
                                        ("No relevant data on 2020, as far as we see, were given", True), ("no, the information provided shows 5", False), ("information is unavailable", True), ("no data. It was provided", False), ("The text, like others, doesn't break out sales", True), ("", False)])
def test_declines(spark, text, want):
    assert one(spark, T.declines(F.lit(text))) is want


@pytest.mark.parametrize("text, want", [("Nothing here lists it; the filing will never show a total", True), ("We did not rise to the occasion in this document", False), ("It is impossible to verify", True), ("It is impossible, verify it", False), ("The data, as provided, are missing", True), ("Missing persons rose", False),
                                        ("There is insufficient further detail", True), ("insufficient funds", False), ("No details are available", True), ("No details", False), ("The materials show no loss", False), ("Not in dispute. The source says 5", False), ("unable to say more than to compute it", False)])
def test_own_sentences_that_decline(spark, text, want):
    assert one(spark, T.declines(F.lit(text))) is want


@pytest.mark.parametrize("text, want", [("dismay 5", [5]), ("May. 5", []), ("5 USD-K", []), ("5-\tmonth", []), ("5 - weeks, 6 days", [6]), ("10 -K", [10]), ("−US$1,000.50 thousands", [-1000.5]), ("5\u00a0%", [5])])
def test_figures_by_their_neighbours(text, want):
    assert [f.amount for f in G.figures(text)] == want


def test_status(spark):
    rows = [(None, True, "declined"), (None, False, "unparsed"), ("N/A", False, "declined"), ("**NOT_IN_DOCUMENTS**", False, "declined"), ("It was 5", True, "partial"), ("Yes. It cannot be verified", False, "partial"), ("It cannot be verified", False, "declined"), ("Sales rose", False, "answered")]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, t boolean")
    assert [r.s for r in df.select(T.answer_status(F.col("a"), F.col("t")).alias("s")).collect()] == [r[2] for r in rows]


def test_clopper_pearson():
    for (k, n), (lo, hi) in {(0, 10): (0, 0.30850), (5, 10): (0.18709, 0.81291), (10, 10): (0.69150, 1)}.items():
        a, b = G.clopper_pearson(k, n)
        assert abs(a - lo) < 1e-5 and abs(b - hi) < 1e-5
    assert G.clopper_pearson(0, 0) is None
    with pytest.raises(ValueError):
        G.clopper_pearson(3, 2)


def test_binomial_interval_of_many_trials():
    """Against sums of the distribution's terms: a tail at each bound is half of alpha."""
    for k, n in [(3, 40), (39, 40), (200, 400), (1, 1)]:
        lo, hi = G.clopper_pearson(k, n)
        below = lambda p, most: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(most + 1))
        assert abs(1 - below(lo, k - 1) - 0.025) < 1e-8 and (k == n or abs(below(hi, k) - 0.025) < 1e-8)


FULL = "**Reasoning:** because\n## Answer: **5**\nCITATIONS: [C1], c02, C9\nQUOTES:\n- C1: \"one\ntwo\"\nC2: x\nConfidence: 80 / 100"


def test_output_parser():
    p = O.parse_output("REASONING: x\nANSWER: 5\nCITATIONS: C1, C9\nCONFIDENCE: 80", 5, O.LABELS)
    assert (p["status"], p["answer"], p["citations"], p["invalid_citations"], p["confidence"], p["issues"]) == ("partial", "5", [1], [9], 80, ["missing_quotes", "citation_out_of_range"])
    full = O.parse_output(FULL, 5, O.LABELS)
    assert full["status"] == "ok" and full["answer"] == "5" and full["quotes"] == [{"label": 1, "text": "one\ntwo"}, {"label": 2, "text": "x"}] and full["confidence"] == 80 and full["reasoning"] == "because"
    again = O.parse_output("so\nANSWER: a\nANSWER: b\nCITATIONS: C1\nCONFIDENCE: high", 5)
    assert again["answer"] == "b" and again["issues"] == ["duplicate_answer", "text_before_first_field", "confidence_unparseable"] and again["confidence"] is None
    chained = O.parse_output("ANSWER: x\nCITATIONS: CONFIDENCE: 70%", 5)
    assert chained["citations"] == [] and chained["confidence"] == 70 and chained["issues"] == ["empty_citations_chained"] and chained["status"] == "partial"
    assert O.parse_output("the NOT_IN_DOCUMENTS token", 5)["abstained"] and O.parse_output("no labels", 5)["status"] == "failed"
    assert O.parse_output("ANSWER: my final answer: 5\nCITATIONS: none\nCONFIDENCE: 101", 5)["issues"] == ["confidence_unparseable"]
    assert O.parse_output("ANSWER: a\nCITATIONS: C1\nQUOTES: C2: y\nCONFIDENCE: 1", 5)["issues"] == ["unrequested_quotes", "quote_for_uncited_label"]


def test_quotes_and_records():
    assert O.quote_status("The cat, sat!", "so the cat sat", []) == "exact"
    assert O.quote_status("", "x", []) == "empty"
    assert O.quote_status("the brown foxes jumped over all of the lazy dogs", "the brown foxes jumpd over all of the lazy dogs", []) == "near"
    assert O.quote_status("abc def", "x", ["abcdef"]) == "other_excerpt"
    assert O.quote_status("abc", "x", []) == "not_found"
    assert O.flatten({"a": {"ci95": [1, 2], "n": 3, "ok": True, "bad": math.inf}, "l": [4]}) == {"a.ci95_lo": 1.0, "a.ci95_hi": 2.0, "a.n": 3.0, "l.0": 4.0}
    assert O.lookup({"a": [{"b": 5}]}, "a.0.b") == 5
    assert O.parse_review("## one\n[x] yes [ ] no\ncomment: fine\n## two\n[ ] yes [ ] no\n")[1]["problem"] == "none marked"
    assert O.typed_literals("{{n1}} of 12") == ["12"]
    assert O.render("{{a}}-{{a}}", {"a": "1"}) == "1-1"


def test_html_blocks():
    page = """<html><body><div style='display:none'>gone</div><script>x()</script><h1>Head</h1><p>one<br>two<p>three
    <div style="page-break-before: always">next</div><table><tr><td>Sales</td><td>$1,200</td></tr><tr><td>Cost</td><td>(300)</td></tr></table></body>"""
    assert H.blocks_of(page) == [("Head", 1, "Head", False), ("one\ntwo", 1, "Head", False), ("three", 1, "Head", False), ("next", 2, "Head", False), ("Sales | $1,200\nCost | (300)", 2, "Head", True)]
    assert H.blocks_of(None) == [] and H.blocks_of("") == []


def test_filing_sources(spark):
    index = H.filing_index("<table><tr><td>1</td><td>d</td><td><a href='/x/a.htm'>a</a></td><td>EX-13.1</td></tr><tr><td>1</td><td>d</td><td><a href='/x/b.htm'>b</a></td><td>10-K</td></tr></table>")
    assert H.exhibits(index, "EX-13") == ["a.htm"]
    assert one(spark, H.first_cik(F.lit("<feed><company-info><cik>1234</cik></company-info></feed>"))) == "0000001234"


def test_snapped_windows():
    text = "word " * 200
    bounds = list(C.snapped_bounds(text, 100, 20))
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text)
    assert all(b[0] < a[1] and b[0] > a[0] for a, b in zip(bounds, bounds[1:], strict=False))
    with pytest.raises(ValueError):
        list(C.snapped_bounds(text, 10, 10))


def test_packing(spark):
    rows = [(1, 0, "A", False, 0, 400), (1, 1, "A", True, 402, 700), (1, 2, "A", False, 702, 1000), (1, 3, "B", False, 1002, 1100), (1, 4, "B", False, 1102, 2400)]
    blocks = spark.createDataFrame(rows, "doc_id long, pos int, section string, is_table boolean, char_start long, char_end long")
    plain = [(r.char_start, r.char_end) for r in C.packed(blocks).orderBy("place").collect()]
    assert plain == [(0, 1000), (1002, 1100), (1102, 2400)]
    alone = [(r.char_start, r.char_end) for r in C.packed(blocks, table_alone=True).orderBy("place").collect()]
    assert alone == [(0, 400), (402, 700), (702, 1000), (1002, 1100), (1102, 2400)]


def test_top_k_and_fusion(spark):
    scored = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate([2, 5, 5, 1])], "query_id long, chunk_id long, score double")
    assert [r.chunk_id for r in R.top_k(scored, 9, "chunk_id").orderBy("rank").collect()] == [1, 2, 0, 3]
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id long, chunk_id long, rank int")
    assert [r.chunk_id for r in R.fuse([a, b], 3).orderBy("rank").collect()] == [20, 10, 30]


def slow_bm25(chunks, queries):
    """{(query, chunk): score} of the pairs that share a term, one pair at a time."""
    n, avg = len(chunks), sum(len(t) for t in chunks.values()) / len(chunks)
    df = {}
    for t in chunks.values():
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    out = {}
    for q, terms in queries.items():
        for c, t in chunks.items():
            if set(terms) & set(t):
                out[q, c] = sum((idf[x] if idf[x] >= 0 else 0.25 * mean) * t.count(x) * 2.5 / (t.count(x) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for x in terms if x in df)
    return out


@pytest.mark.parametrize("block, pairs", [(2000, 1 << 20), (2, 7)])
def test_bm25_equals_slow_scores(spark, monkeypatch, block, pairs):
    """Repeated terms, terms that most chunks have, ties, empty chunks and questions; in one block and in several."""
    import random

    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    monkeypatch.setattr(R, "PAIRS", pairs)
    rng = random.Random(5)
    chunks = {i: [rng.choice("aaabcdefgh") for _ in range(rng.randrange(0, 12))] for i in range(60)}
    queries = {i: [rng.choice("abcdxyh") for _ in range(rng.randrange(0, 5))] for i in range(7)}
    c = spark.createDataFrame([(i, " ".join(t)) for i, t in chunks.items()], "chunk_id long, text string").repartition(5)
    q = spark.createDataFrame([(i, t) for i, t in queries.items()], "query_id long, qt array<string>")
    tokens, asked, want = T.tokens(F.col("text")), F.col("qt"), slow_bm25(chunks, queries)
    best = lambda scores, k: {(i, c): (round(s, 6), r) for i in queries for r, (s, c) in enumerate(sorted(((s, c) for (j, c), s in scores.items() if j == i), key=lambda x: (-round(x[0], 6), x[1]))[:k], 1)}
    found = R.top_k(R.bm25(c, q, tokens, asked, 4), 4, "chunk_id").collect()
    assert {(r.query_id, r.chunk_id): (round(r.score, 6), r["rank"]) for r in found} == best(want, 4)
    every = {(r.query_id, r.chunk_id): r.score for r in R.bm25_pairs(c, c, q, tokens, asked).collect()}
    assert every.keys() == want.keys() and all(abs(every[k] - want[k]) < 1e-5 for k in want)
    filled = R.top_k(R.with_zero_scores(R.bm25(c, q, tokens, asked, 60), c, q, tokens, asked, 60), 60, "chunk_id").collect()
    assert {(r.query_id, r.chunk_id): (round(r.score, 6), r["rank"]) for r in filled} == best({(i, c): want.get((i, c), 0.0) for i in queries if queries[i] for c in chunks}, 60) | {(r.query_id, r.chunk_id): (0.0, r["rank"]) for r in filled if not queries[r.query_id]}
    none = R.bm25(c.filter("false"), q, tokens, asked, 4).count() + R.bm25(c, q.filter("false"), tokens, asked, 4).count()
    assert none == 0


def test_hashed_search_equals_slow_products(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    texts = {i: [f"t{(i * 7 + j * j) % 23}" for j in range(i % 6)] for i in range(40)}
    asked = {i: texts[i * 5 + 1] for i in range(5)}
    cell = lambda t: int(t[1:]) % 8
    vector = lambda ts: [sum(cell(t) == k for t in ts) for k in range(8)]
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v] if any(v) else v
    scores = {(q, c): sum(x * y for x, y in zip(unit(vector(a)), unit(vector(b)), strict=True)) for q, a in asked.items() for c, b in texts.items()}
    c = spark.createDataFrame([(i, t) for i, t in texts.items()], "chunk_id long, t array<string>").repartition(3)
    q = spark.createDataFrame([(i, t) for i, t in asked.items()], "query_id long, qt array<string>")
    found = R.top_k(R.hashed_search(c, q, F.col("t"), F.col("qt"), lambda x: F.substring(x, 2, 9).cast("int"), 3, 8), 3, "chunk_id").collect()
    want = {(i, c) for i in asked for _, c in sorted((-round(scores[i, c], 6), c) for c in texts if scores[i, c] > 0)[:3]}
    assert {(r.query_id, r.chunk_id) for r in found} == want


def test_plain_windows(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "é😀"[i % 2] for i in range(233))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x"), (5, text[:30]), (6, "a\nb" * 9)], "doc_id long, text string")
    for size, lap in ((20, 5), (10, 8), (30, 0)):
        got = sorted(tuple(r) for r in C.plain_windows(docs, size, lap).select("doc_id", "char_start", "char_end", "text").collect())
        want = [(d, s, min(s + size, len(t)), t[s : s + size]) for d, t in ((1, text), (4, "x"), (5, text[:30]), (6, "a\nb" * 9)) for s in range(0, len(t), size - lap) if s == 0 or s + lap < len(t)]
        assert got == sorted(want)


def test_union_length(spark):
    iv = spark.createDataFrame([(1, 0, 60), (1, 40, 80), (1, 90, 95)], "k int, s long, e long")
    assert R.union_length(iv, ["k"]).first().covered == 85


def test_kappa_and_ranks(spark):
    same = spark.createDataFrame([("x", "x")] * 5, "a string, b string")
    assert A.cohen_kappa(same, "a", "b").first().kappa is None
    pairs = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y")], "a string, b string")
    assert abs(A.cohen_kappa(pairs, "a", "b").first().kappa - 0.5) < 1e-9
    v = spark.createDataFrame([(10,), (20,), (20,), (30,)], "v int")
    assert sorted(r["rank"] for r in A.mid_ranks(v, "v").collect()) == [1, 2.5, 2.5, 4]


def test_stream_equals_batch(spark, small, tmp_path):
    from siltstone.streaming import events as E

    table = spark.read.parquet(f"{small}/events.parquet")
    table.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = E.summarise(E.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    live = {(r.event_type, r.window.start): (r.n, round(r.total, 6)) for r in spark.table("windows").collect()}
    batch = {(r.event_type, r.window.start): (r.n, round(r.total, 6)) for r in E.summarise(table).collect()}
    assert live == batch
    log = E.write_request_log(E.read_events(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp"))
    log.awaitTermination()
    assert spark.read.text(str(tmp_path / "log")).count() == table.count()


def plain_status(quote, own):
    import difflib

    norm = lambda t: re.sub("[^a-z0-9]", "", t.lower())
    q, mine = norm(quote), norm(own)
    if not q or q in mine:
        return "exact" if q else "empty"
    runs = difflib.SequenceMatcher(None, mine, q, autojunk=False).get_matching_blocks()
    return "near" if sum(r.size for r in runs if r.size >= 8) >= 0.9 * len(q) else "not_found"


@pytest.mark.parametrize("crowded", [0, 32])
def test_quotes_as_difflib_has_them(monkeypatch, crowded):
    """Words of few letters, shuffled, repeated and with letters changed: by grams and by ranks."""
    monkeypatch.setattr(O, "CROWDED", crowded)
    rng, seen = random.Random(4), []
    for _ in range(1500):
        words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 5))]
        own = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))
        a = rng.randrange(len(own) + 1)
        quote = list(own[a : a + rng.randrange(150)])
        for _ in range(rng.randrange(4)):
            quote.insert(rng.randrange(len(quote) + 1), rng.choice(["", "zq", "b", "abab", words[0] * 2]))
        quote = "".join(quote)
        seen.append(plain_status(quote, own))
        assert O.quote_status(quote, own, []) == seen[-1]
    assert min(seen.count(x) for x in ("near", "exact", "not_found", "empty")) > 20


@pytest.mark.parametrize("word", ["word ", "a", "".join(f"w{i * 7919 % 1009} " for i in range(300))])
def test_quotes_of_long_texts_are_quick(word):
    import time

    own = (word * 60_000)[:60_000]
    quotes = [own[:30_000] + "zq" + own[30_000:], "words that nobody wrote in any of them", *(own[i : i + 60] for i in range(0, 60_000, 60))]
    began = time.perf_counter()
    states = [x for x in O.quote_fidelity([{"label": 1, "text": q} for q in quotes], {1: own})["states"]]
    assert states[:2] == ["near", "not_found"] and set(states[2:]) == {"exact"}
    assert time.perf_counter() - began < 20
