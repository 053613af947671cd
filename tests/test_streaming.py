"""Streams with state: a budget decided live as replayed, and a runner that sends each key once whatever dies."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.plans import PLANS
from siltstone.streaming import budget as B
from siltstone.streaming import runner as R


def operations(seed, n=400, projects=3):
    rng, start, rows, open_ = random.Random(seed), dt.datetime(2024, 1, 1), [], []
    for i in range(n):
        ts = start + dt.timedelta(seconds=rng.randrange(20) + 30 * i)
        kind = rng.random()
        if kind < 0.55 or not open_:
            rows.append((rng.choice([*range(projects), None]), i, ts, "reserve", f"r{i}", rng.choice(["p", "q", None]), rng.choice([0.5, 1.0, 2.25, None])))
            open_.append(rows[-1])
        else:
            p, _, _, _, r, ph, a = rng.choice(open_)
            rows.append((p, i, ts, rng.choice(["settle", "settle", "release", "reserve", "lose"]), r, ph, a))
    return rows


def slow(rows, project_cap, phase_cap, ttl):
    """Decisions from the whole history before each operation."""
    out = {}
    for project in {r[0] for r in rows}:
        done = []
        for r in sorted((r for r in rows if r[0] == project), key=lambda r: (r[2], r[1])):
            _, seq, ts, op, request, phase, amount = r
            phase, amount = phase or "", amount or 0.0
            flying, spent = {}, {}
            for t, o, q, ph, a, decision in done:
                flying = {k: v for k, v in flying.items() if (t - v[2]).total_seconds() < ttl}
                if decision == "reserved" and q not in flying:
                    flying[q] = (ph, a, t)
                if decision.startswith("settled"):
                    spent[ph] = spent.get(ph, 0) + a
                if decision in ("settled", "released"):
                    flying.pop(q, None)
            flying = {k: v for k, v in flying.items() if (ts - v[2]).total_seconds() < ttl}
            held = sum(v[1] for v in flying.values())
            if op == "reserve":
                decision = "reserved" if request in flying else "refused_project" if sum(spent.values()) + held + amount > project_cap + 1e-9 else "refused_phase" if spent.get(phase, 0) + held + amount > phase_cap + 1e-9 else "reserved"
            elif op == "settle":
                decision = "settled" if request in flying else "settled_late"
            else:
                decision = "released" if op == "release" and request in flying else "unknown"
            done.append((ts, op, request, phase, amount, decision))
            out[project, seq] = decision
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_replayed_decisions_equal_the_history(spark, seed):
    rows = operations(seed)
    df = spark.createDataFrame(rows, B.OPERATIONS).repartition(5)
    got = {(r.project, r.seq): r.decision for r in B.replayed_decisions(df, 20.0, 12.0, 900.0).collect()}
    assert got == slow(rows, 20.0, 12.0, 900.0)
    assert len(set(got.values())) == 7


def test_caps_hold_at_every_moment(spark):
    rows = operations(3, 800)
    got = B.replayed_decisions(spark.createDataFrame(rows, B.OPERATIONS), 30.0, 18.0, 600.0)
    assert got.filter("decision = 'reserved' AND spent + reserved > 30").count() == 0
    assert B.replayed_decisions(spark.createDataFrame([], B.OPERATIONS), 1.0, 1.0).count() == 0


def test_the_stream_decides_as_the_replay_and_survives_restarts(spark, tmp_path):
    rows = sorted((r for r in operations(4, 300) if r[0] is not None), key=lambda r: (r[2], r[1]))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    want = {(r.project, r.seq): (r.decision, r.spent, r.reserved) for r in B.replayed_decisions(spark.createDataFrame(rows, B.OPERATIONS), 20.0, 12.0, 900.0).collect()}
    source, sink, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    os.makedirs(source)

    def run(part, name):
        spark.createDataFrame(part, B.OPERATIONS).coalesce(1).write.parquet(f"{source}/{name}")
        stream = spark.readStream.schema(B.OPERATIONS).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        q = B.live_decisions(stream, 20.0, 12.0, 900.0).writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    for i in range(3):  # every part is a query started anew
        run(rows[100 * i : 100 * i + 100], f"f{i}")
    got = spark.read.parquet(sink).collect()
    assert len(got) == len(rows) and {(r.project, r.seq): (r.decision, r.spent, r.reserved) for r in got} == want


def test_budget_query(spark, small):
    got = PLANS["budget_reservations"](spark, small)
    counts = {r.decision: r["count"] for r in got.groupBy("decision").count().collect()}
    assert {"reserved", "settled", "released", "refused_project", "refused_phase"} <= set(counts)
    assert got.filter("decision = 'reserved' AND spent + reserved > 2.0").count() == 0


class Counted:
    """A service in a folder; dies at a chosen call, and answers with failures for keys that say so."""

    def __init__(self, folder, die_at=None):
        self.folder, self.die_at, self.calls = folder, die_at, 0
        os.makedirs(folder, exist_ok=True)

    def _step(self, where):
        self.calls += 1
        if self.die_at == (where, self.calls) or self.die_at == where:
            self.die_at = None
            raise RuntimeError("died")

    def knows(self, submission):
        return os.path.exists(f"{self.folder}/{submission}.json")

    def submit(self, submission, folder):
        import pyarrow.parquet as pq

        self._step("before")
        assert not self.knows(submission)
        rows = pq.read_table(folder.removeprefix("file:")).to_pylist()
        with open(f"{self.folder}/{submission}.json", "w") as f:
            json.dump(rows, f)
        self._step("after")

    def collect(self, spark, submission):
        self._step("collect")
        rows = json.load(open(f"{self.folder}/{submission}.json"))
        return spark.createDataFrame([(r["key"], f"re {r['request']}", "bad" in r["request"] and r["attempt"] < 2) for r in rows if "lost" not in r["request"]], "key string, response string, failed boolean")

    def sent(self):
        out = []
        for name in sorted(os.listdir(self.folder)):
            out += [(r["key"], r["attempt"]) for r in json.load(open(f"{self.folder}/{name}"))]
        return out


def drive(spark, tmp_path, service, parts, **kw):
    """Runs the stream until it ends, starting it anew when it dies; gives the number of starts."""
    source = str(tmp_path / "requests")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, R.REQUESTS).coalesce(1).write.mode("overwrite").parquet(f"{source}/p{i}")
    starts = 0
    while True:
        starts += 1
        runner = R.BatchRunner(spark, f"file://{tmp_path}/state", service, **kw)
        stream = spark.readStream.schema(R.REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        try:
            runner.start(stream, str(tmp_path / "log")).awaitTermination()
            return starts, runner
        except Exception as e:
            assert "died" in str(e)


PARTS = [[(f"k{i}", f"ask {i}", 1.0) for i in range(12)] + [("k3", "ask 3", 1.0), (None, "x", 1.0)], [(f"k{i}", f"ask {i}", 1.0) for i in range(8, 20)] + [("kb", "bad one", 50.0), ("kl", "lost one", 1.0)]]


@pytest.mark.parametrize("die_at", [None, "before", "after", "collect", ("after", 5)])
def test_each_key_is_sent_once(spark, tmp_path, die_at):
    service = Counted(str(tmp_path / "service"), die_at)
    starts, runner = drive(spark, tmp_path, service, PARTS, most=5, most_cost=8.0, attempts=2)
    assert (starts > 1) == (die_at is not None)
    assert sorted(service.sent()) == sorted([(f"k{i}", 1) for i in range(20)] + [("kb", 1), ("kb", 2), ("kl", 1), ("kl", 2)])
    done = runner.done().collect()
    last = {r.key: (r.response, r.failed, r.attempt) for r in sorted(done, key=lambda r: r.attempt)}
    assert last["k3"] == ("re ask 3", False, 1) and last["kb"] == ("re bad one", False, 2) and last["kl"] == (None, True, 2) and len(last) == 22
    sizes = runner.spark.createDataFrame([(r.submission,) for r in done], "s string").groupBy("s").count().agg(F.max("count")).first()[0]
    assert sizes <= 5
