"""A budget with reservations: calls reserve their worst case, settle what they cost, or give the reservation back.

Two caps hold: one of the project and one of the phase.  A reservation is granted if what has
been spent, all that is reserved and the call's worst case stay within both.  Reservations that
are neither settled nor released lapse after ``ttl`` seconds of event time.

One ledger a project is the state of a stream (``live_decisions``) or of a sorted table
(``replayed_decisions``); both give the same decisions for the same order of operations.  Caps
make a project's decisions sequential, so its operations pass through one task, in constant
memory: the state holds what is spent by phase and the reservations in flight.

Defined results: operations go by time, then ``seq``; a null amount counts as 0; a repeated
``reserve`` of a request in flight gets the answer ``reserved`` and reserves nothing more; what
settles without a reservation in flight is spent all the same (``settled_late``), as the
money is gone; a release without one is ``unknown``; so is any other operation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OPERATIONS = "project long, seq long, ts timestamp, op string, request string, phase string, amount double"
DECISIONS = "project long, seq long, request string, decision string, spent double, reserved double"
#: Amounts are kept in whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000


@dataclass
class Ledger:
    """What is spent, by phase, and the reservations in flight: request to (phase, amount, second of its end)."""

    project_cap: int
    phase_cap: int
    ttl: float
    spent: int = 0
    by_phase: dict[str, int] = field(default_factory=dict)
    held: dict[str, tuple[str, int, float]] = field(default_factory=dict)

    @property
    def reserved(self) -> int:
        return sum(amount for _, amount, _ in self.held.values())

    def lapse(self, now: float) -> None:
        for request in [r for r, (_, _, until) in self.held.items() if until <= now]:
            del self.held[request]

    def decide(self, op: str, request: str, phase: str, amount: int, now: float) -> str:
        self.lapse(now)
        if op == "reserve":
            if request in self.held:
                return "reserved"
            committed = self.reserved + amount
            if self.spent + committed > self.project_cap:
                return "refused_project"
            if self.by_phase.get(phase, 0) + committed > self.phase_cap:
                return "refused_phase"
            self.held[request] = (phase, amount, now + self.ttl)
            return "reserved"
        if op == "settle":
            known = self.held.pop(request, None)
            self.spent += amount
            self.by_phase[phase] = self.by_phase.get(phase, 0) + amount
            return "settled" if known else "settled_late"
        if op == "release" and self.held.pop(request, None):
            return "released"
        return "unknown"

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Decisions of rows in their order."""
        out = []
        for r in rows.itertuples():
            amount = 0 if pd.isna(r.amount) else round(r.amount * UNIT)
            decision = self.decide(r.op, r.request, r.phase or "", amount, r.ts.timestamp())
            out.append((r.project, r.seq, r.request, decision, self.spent / UNIT, self.reserved / UNIT))
        return pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")])


class BudgetProcessor(StatefulProcessor):
    """The ledger of a project as state of a stream."""

    def __init__(self, project_cap: float, phase_cap: float, ttl: float):
        self.caps = round(project_cap * UNIT), round(phase_cap * UNIT), ttl

    def init(self, handle) -> None:
        self.spent = handle.getMapState("spent", "phase string", "amount long")
        self.held = handle.getMapState("held", "request string", "phase string, amount long, until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        by_phase = {k[0]: v[0] for k, v in self.spent.iterator()}
        ledger = Ledger(*self.caps, spent=sum(by_phase.values()), by_phase=by_phase, held={k[0]: tuple(v) for k, v in self.held.iterator()})
        before = set(ledger.held)
        # The rows of one trigger, whose size the stream bounds, are put in order.
        yield ledger.run(pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable"))
        for phase, amount in ledger.by_phase.items():
            self.spent.updateValue((phase,), (amount,))
        for request in before - set(ledger.held):
            self.held.removeKey((request,))
        for request, value in ledger.held.items():
            self.held.updateValue((request,), value)

    def close(self) -> None:
        pass


def live_decisions(operations: DataFrame, project_cap: float, phase_cap: float, ttl: float = 3600.0) -> DataFrame:
    """Decisions on a stream of operations that come in order of time (those of one trigger in any order); state survives restarts.

    The session must keep state in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    return operations.groupBy("project").transformWithStateInPandas(BudgetProcessor(project_cap, phase_cap, ttl), DECISIONS, "Append", "None")


def replayed_decisions(operations: DataFrame, project_cap: float, phase_cap: float, ttl: float = 3600.0) -> DataFrame:
    """The same decisions on a table."""
    caps = round(project_cap * UNIT), round(phase_cap * UNIT), ttl

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, ledger = None, None
        for f in frames:
            for name, part in f.groupby("project", sort=False, dropna=False):
                if ledger is None or (name != project and not (pd.isna(name) and pd.isna(project))):
                    project, ledger = name, Ledger(*caps)
                yield ledger.run(part)

    names = [c.split()[0] for c in OPERATIONS.split(", ")]
    return operations.select(*names).repartition("project").sortWithinPartitions("project", "ts", "seq").mapInPandas(run, DECISIONS)


def operations_of_events(events: DataFrame, projects: int = 40) -> DataFrame:
    """Calls of an event log as operations: each reserves one and a half times its cost and settles it after half an hour, but
    one in five is released after ten minutes and one in seven is never heard of again; one in eleven asks twice."""
    cost, key = F.col("value") / 1000, F.col("event_id")
    step = lambda op, after, amount, n: F.struct(F.lit(op).alias("op"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(after))).alias("at"), amount.alias("amount"), F.lit(n).alias("n"))
    reserve = step("reserve", 0, cost * 1.5, 0)
    end = F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, step("release", 10, F.lit(0.0), 2)).otherwise(step("settle", 30, cost, 2))
    again = F.when(key % 11 == 0, step("reserve", 1, cost * 1.5, 1))
    steps = F.array_compact(F.array(reserve, again, end))
    rows = events.select((F.col("user_id") % projects).alias("project"), key.alias("key"), F.col("event_type").alias("phase"), F.explode(steps).alias("s"))
    return rows.select("project", (F.col("key") * 3 + F.col("s.n")).alias("seq"), F.col("s.at").alias("ts"), F.col("s.op").alias("op"), F.col("key").cast("string").alias("request"), "phase", F.col("s.amount").alias("amount"))
