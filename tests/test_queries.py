"""Every registered query of the engine against its SQL twin on the small tables; those without one must return rows."""

import pytest

from siltstone.plans import PLANS, SQL

MAY_BE_EMPTY = {"gold_figure_spot_check", "figure_extract"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, small, same_rows, name):
    same_rows(PLANS[name](spark, small), SQL[name])


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_rows_only(spark, small, name):
    rows = PLANS[name](spark, small).count()
    assert rows > 0 or name in MAY_BE_EMPTY


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def put(spark, folder, docs, items):
    spark.createDataFrame(list(enumerate(docs, 1)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_evidence_of_any_length_and_word_breaks(spark, tmp_path):
    docs = ["the quick brown fox jumps over the lazy dog of the house", "the quick bro-\nwn foxjumps over the la zy dog", "über 漢字テスト das", "nothing here to be found at all", None, "", "x"]
    items = ["brown fox jumps over the lazy dog", "quick", "漢字テスト", "dog of", "", None, "?!"]
    sf = put(spark, tmp_path, docs, items)
    plain = lambda t: "".join(c for c in t.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    pairs = [(i, d, x, y) for i, x in enumerate(items, 1) for d, y in enumerate(docs, 1) if x and y]
    exact = {(i, d, plain(y).index(plain(x))) for i, d, x, y in pairs if plain(x) and plain(x) in plain(y)}
    assert {(1, 2), (2, 1), (4, 1)} <= {e[:2] for e in exact}
    assert {(r.item_id, r.doc_id, r.norm_start) for r in PLANS["evidence_alignment_exact"](spark, sf).collect()} == exact
    scan = {r.item_id: r.in_corpus for r in PLANS["question_scan_in_corpus"](spark, sf).collect()}
    assert {i for i, known in scan.items() if known} == {i for i, _, x, y in pairs if x in y}


def aligned(needle, hay):
    """(start, end, coverage) of the window rule in plain Python, or None."""
    import statistics

    if len(needle) <= 30 or needle in hay:
        return None
    offsets = sorted({*range(0, len(needle) - 29, 30), len(needle) - 30})
    spots = {o: [i for i in range(len(hay)) if hay.startswith(needle[o : o + 30], i)] for o in offsets}
    anchors = [(o, at[0]) for o, at in spots.items() if len(at) == 1]
    if not anchors:
        return None
    centre = statistics.median(p - o for o, p in anchors)
    kept = [p for o, p in anchors if abs(p - o - centre) <= len(needle)]
    return (min(kept), max(kept) + 30, round(len(kept) / len(offsets), 6)) if len(kept) * 2 >= len(offsets) else None


def test_evidence_that_is_not_exact(spark, tmp_path):
    import random

    letters = random.Random(5)
    prose = lambda n: "".join(letters.choice("abcdefghij") for _ in range(n))
    item, short, odd = prose(130), prose(30), prose(95)
    docs = [
        prose(40) + item + prose(40),  # exact
        prose(40) + item[:70] + "runningheader" + item[70:] + prose(9),  # inserted header
        prose(40) + item[:64] + "z" + item[65:] + prose(40),  # changed figure
        item[60:] + prose(50),  # cut copy: 60, 90 and the last window
        item[70:] + prose(50),  # two of five windows
        item[:64] + "z" + item[65:] + prose(7) + item[:64],  # repeated windows do not count: two of five
        short[:29],
        odd[1:] + prose(20),  # without the first window, the last one flush
        prose(300),
    ]
    items = [item, short, odd]
    sf = put(spark, tmp_path, docs, items)
    want = {(i, d, *a) for i, x in enumerate(items, 1) for d, y in enumerate(docs, 1) if (a := aligned(x, y))}
    assert {w[:2] for w in want} == {(1, 2), (1, 3), (1, 4), (3, 8)}
    assert {tuple(r[c] for c in ("item_id", "doc_id", "norm_start", "norm_end", "coverage")) for r in PLANS["evidence_alignment_partial"](spark, sf).collect()} == want


def test_oracle_context_below_rank_100(spark, tmp_path):
    """120 documents repeat the question's first words; the gold document's chunks score below theirs, or nothing."""
    words = "aa bb cc dd ee ff gg hh"
    item = words + " ii jj kk ll mm nn oo pp"
    gold = "zz " * 400 + item + " zz" * 400
    sf = put(spark, tmp_path, [(words + " ") * 8 for _ in range(120)] + [gold], [item])
    rows = PLANS["oracle_context_filing"](spark, sf).collect()
    assert {r.chunk_id // 10_000_000 for r in rows} == {121} and len(rows) == 5
    # The item ends at 1,247: windows of 512 every 448, of which that from 896 holds it.
    assert [(r.chunk_id % 10_000_000, r["class"]) for r in rows if r["class"] < 2] == [(2, 0)]
    assert sorted(r.place for r in rows) == [1, 2, 3, 4, 5]


def test_reports_of_odd_balances(spark, tmp_path):
    """Minus zero, halves that binary numbers miss, infinite, null and large balances, null names and keys, as the SQL has them."""
    import duckdb

    balances = [-0.0, 0.0, -0.001, -0.004999, 0.005, 1.005, 0.285, 1.115, 2.675, -2.675, 0.125, 1e15 + 0.125, float("inf"), float("-inf"), float("nan"), None, 999.99]
    rows = [(i, f"Customer#{i}", b) for i, b in enumerate(balances, 1)] + [(100, None, 1.5), (None, "nobody", -0.0), (-5, "{{name}} \\1", 3.0), (2**53 + 1, "large", 1.0)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = con.execute(SQL["rendered_reports"]).fetchall()
    got = [tuple(r) for r in PLANS["rendered_reports"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
