"""Repair of conversation structure by the tight arcs of an edit lattice.

A conversation in order of turns is a lattice: a column for each place between rows and four
states for what the repaired roles so far end in (nothing, system, user, assistant).  Arcs are
the edits Keep, Rerole and Delete of the next row, and Insert of an empty row.  Forward costs
(from the start) and backward costs (to the end) of every node tell which arcs lie on a
cheapest path: those whose forward cost, own cost and backward cost add up to the least total.
These tight arcs form an acyclic graph.  A traversal keeps the set of all nodes that the edits
chosen so far can have led to, and takes the least letter among their tight arcs; a set has
four nodes at most, so it is a mask of four bits.

Many conversations are solved at once, column by column, in numpy.  Equal rows (conversation,
turn, role, text) are one row with a number, as all copies but the first are deleted anyway; so a
row that occurs very often adds nothing to a group.  A conversation of more than ``SEGMENT``
different rows is cut into segments that any task can work on: a segment is first reduced to
the costs from each state to each other (a 4 by 4 matrix), the few rows of matrices give the
costs at its borders, then to the set that each entering set leaves as, and with its entering
set known its letters follow.  What is streamed by conversation in between is one small row a
segment.  Only the digest of the repaired text, which is sequential by its definition, and the
audit, one string, bring a conversation together: its rows pass sorted through one task, which
holds one batch and the letters.

Order and ties: rows go by turn (nulls first), rows of one turn by role and then by the hash of
the text (16 bytes of SHA-256, which also stands for the text where texts are compared).

Defined results: a null role or text is one space, a null id or turn is one space in the lot
that damages rows; rows with a null id are one conversation; a role with another initial than
s, u or a (an empty or null one too) cannot be kept; repeated rows are repeated in all counts;
very long texts are hashed whole; no rows give no rows; columns beside the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only, shuffle_width, tidied

#: Rows of a conversation that are solved together; longer ones are cut.
SEGMENT = 8192
#: Padded cells of the lattices solved at once.
CELLS = 1 << 16
SPACES = " \t\n\x0b\x0c\r"
ORDER = ("turn", "role", "digest")

START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = "DIKR"
FORCED = 8
#: Where an inserted or reroled row leads: user after nothing, system or assistant, else assistant.
TURN_TO = np.array([USER, USER, ASSISTANT, USER])
#: Where a kept row with initial s, u, a or another leads from each state; -1: nowhere.
KEPT_TO = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
FAR = 1 << 60
ACCEPTED = np.array([0, FAR, FAR, 0])
#: What it costs to end well from each state by insertions.
CLOSING = np.array([0, 10, 5, 0])
AT_START = np.array([0, FAR, FAR, FAR])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, with ``copies`` (0 where a row is dropped)."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    rows = only(conversations, "conv_id", "turn", "role", "text").withColumn("lot", lot)
    text = F.when(F.col("lot") == 1, F.lit("")).when(F.col("lot") == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(F.col("lot") == 4, F.lit("user")).otherwise(spaced("role"))
    copies = F.when(F.col("lot") == 0, 0).when(F.col("lot") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def distinct_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, blank, truncated and how often each row occurs (``n``)."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    marked = rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "copies")
    return marked.filter("copies > 0").groupBy("conv_id", *ORDER, "blank", "truncated").agg(F.sum("copies").alias("n"))


def join_by(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join that takes nulls for equal; the right side's keys are dropped."""
    named = right.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns])
    same = None
    for c in keys:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = one if same is None else same & one
    out = left.join(named, same, how)
    return out if how in ("left_anti", "left_semi") else out.drop(*[f"_{c}" for c in keys])


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``later``: an earlier row of the conversation has this role and text."""
    at = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    firsts = rows.filter("NOT blank").groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"))
    return join_by(rows, firsts, ["conv_id", "role", "digest"]).withColumn("later", F.coalesce(~at.eqNullSafe(F.col("first")), F.lit(False))).drop("first")


def with_kinds(rows: DataFrame) -> DataFrame:
    """Adds ``initial``, the place of the role's initial in ``sua`` (3: another), and ``kind``: 8 if the row must go, else ``initial``, and 4 more if truncated."""
    place = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    coded = rows.withColumn("initial", F.when((F.col("role") == "") | (place == 0), 3).otherwise(place - 1).cast("int"))
    kept = F.col("initial") + F.when(F.col("truncated"), 4).otherwise(0)
    return coded.withColumn("kind", F.when(F.col("blank") | F.col("later"), FORCED).otherwise(kept).cast("int"))


# ---- lattices of many conversations at once -------------------------------------------------


class Lattice:
    """Costs and tight arcs of sequences of rows, left-aligned; a column past a sequence passes states on unchanged.

    ``start`` and ``end`` are the costs before the first and after the last row of each
    sequence; ``last`` marks sequences after whose rows something can still be inserted.
    """

    def __init__(self, kind: np.ndarray, n: np.ndarray, sizes: np.ndarray, start: np.ndarray, end: np.ndarray | None, last: np.ndarray):
        count, width = len(sizes), int(sizes.max()) + 1
        self.sizes, self.width = sizes, width
        row, at = np.repeat(np.arange(count), sizes), np.arange(len(kind)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        k, m = np.full((count, width), FORCED), np.zeros((count, width), np.int64)
        k[row, at], m[row, at] = kind, n
        self.free, self.inside = k != FORCED, np.arange(width) < sizes[:, None]
        self.open = self.inside | ((np.arange(width) == sizes[:, None]) & last[:, None])
        self.drop = 2 * m  # nothing on the columns past the rows
        self.hold = np.where(self.free, 5 * (k // 4 % 2) + 2 * (m - 1), FAR)
        self.kept = np.where(self.free[..., None], KEPT_TO[k % 4], -1)
        self.before = self._forward(start)
        if end is not None:
            self.after = self._backward(end)
            self.tight = self._tight()

    def _forward(self, start: np.ndarray) -> np.ndarray:
        f = np.empty((len(self.sizes), self.width + 1, 4), np.int64)
        f[:, 0] = start
        for j in range(self.width):
            here, open_ = f[:, j], self.open[:, j]
            here[open_, ASSISTANT] = np.minimum(here[open_, ASSISTANT], here[open_, USER] + 5)
            here[open_, USER] = np.minimum(here[open_, USER], here[open_][:, [START, SYSTEM, ASSISTANT]].min(1) + 5)
            here[open_, ASSISTANT] = np.minimum(here[open_, ASSISTANT], here[open_, USER] + 5)
            there = here + self.drop[:, j, None]
            hold = self.hold[:, j]
            for q in range(4):
                free = self.free[:, j]
                there[free, TURN_TO[q]] = np.minimum(there[free, TURN_TO[q]], here[free, q] + hold[free] + 1)
                rows = np.flatnonzero(self.kept[:, j, q] >= 0)
                to = self.kept[rows, j, q]
                there[rows, to] = np.minimum(there[rows, to], here[rows, q] + hold[rows])
            f[:, j + 1] = np.minimum(there, FAR)
        return f

    def _backward(self, end: np.ndarray) -> np.ndarray:
        b = np.empty((len(self.sizes), self.width + 1, 4), np.int64)
        b[:, self.width] = end
        for j in range(self.width - 1, -1, -1):
            there = b[:, j + 1]
            here = there + self.drop[:, j, None]
            free, hold = self.free[:, j], self.hold[:, j]
            for q in range(4):
                here[free, q] = np.minimum(here[free, q], there[free, TURN_TO[q]] + hold[free] + 1)
                rows = np.flatnonzero(self.kept[:, j, q] >= 0)
                here[rows, q] = np.minimum(here[rows, q], there[rows, self.kept[rows, j, q]] + hold[rows])
            open_ = self.open[:, j]
            here[open_, USER] = np.minimum(here[open_, USER], here[open_, ASSISTANT] + 5)
            for q in (START, SYSTEM, ASSISTANT):
                here[open_, q] = np.minimum(here[open_, q], here[open_, USER] + 5)
            here[open_, USER] = np.minimum(here[open_, USER], here[open_, ASSISTANT] + 5)
            b[:, j] = np.minimum(here, FAR)
        return b

    @property
    def total(self) -> np.ndarray:
        return (self.before[:, 0] + self.after[:, 0]).min(1)

    def _tight(self) -> np.ndarray:
        """For each letter, sequence, column and state the bit of the state that the tight arc leads to; 0 where it is none."""
        here, there, total = self.before[:, : self.width], self.after[:, 1:], self.total[:, None, None]
        reached = here < FAR
        bits = np.uint8(1) << np.arange(4, dtype=np.uint8)
        out = np.zeros((4, len(self.sizes), self.width, 4), np.uint8)
        free, hold = self.free[..., None], self.hold[..., None]
        out[DELETE] = np.where(reached & self.inside[..., None] & (here + self.drop[..., None] + there == total), bits, 0)
        out[INSERT] = np.where(reached & self.open[..., None] & (here + 5 + self.after[:, : self.width][..., TURN_TO] == total), bits[TURN_TO], 0)
        kept = np.maximum(self.kept, 0)
        out[KEEP] = np.where(reached & (self.kept >= 0) & (here + hold + np.take_along_axis(there, kept, 2) == total), bits[kept], 0)
        out[REROLE] = np.where(reached & free & (here + hold + 1 + there[..., TURN_TO] == total), bits[TURN_TO], 0)
        return out

    def walk(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letter of each row, number of insertions before each column, and the set of states left at the end.

        ``mask`` is the set of states that each sequence starts from.
        """
        count = len(self.sizes)
        letter, inserted = np.full((count, self.width), -1, np.int8), np.zeros((count, self.width), np.int64)
        mask, at = mask.astype(np.uint8).copy(), np.zeros(count, np.int64)
        live = np.flatnonzero(mask)
        while len(live):
            held = (mask[live, None] >> np.arange(4, dtype=np.uint8)) & 1
            led = np.bitwise_or.reduce(self.tight[:, live, at[live]] * held[None], axis=2)
            choice = (led != 0).argmax(0)
            went = led[choice, np.arange(len(live))]
            moved = went != 0
            done = live[~moved]
            # A set without tight arcs is at the end of its sequence, or was never on a cheapest path.
            mask[done[at[done] < self.sizes[done]]] = 0
            live, choice = live[moved], choice[moved]
            mask[live] = went[moved]
            new = choice == INSERT
            inserted[live[new], at[live[new]]] += 1
            letter[live[~new], at[live[~new]]] = choice[~new]
            at[live[~new]] += 1
        return letter, inserted, mask


def _illegal(role: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Adjacent rows, copies included, whose initials (places in ``sua``) may not follow each other."""
    inner = n - 1
    if len(role) > 1:
        pair = role[:-1] * 4 + role[1:]
        edge = np.zeros(len(role), bool)
        edge[np.cumsum(sizes)[:-1]] = True
        inner[1:] += ~edge[1:] & ~np.isin(pair, _LEGAL)
    return np.add.reduceat(inner, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, np.int64)


#: system then user, user then assistant, assistant then user.
_LEGAL = (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1)


def _runs(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences of like length, as many at once as fit ``CELLS``."""
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (sizes[order[j]] + 1) * (j + 1 - i) <= CELLS and sizes[order[j]] <= 2 * sizes[order[i]] + 8:
            j += 1
        yield order[i:j]
        i = j


def _take(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1])) + np.repeat(starts - (ends - sizes), sizes)


def solve(kind: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter and insertions before each row, insertions after the last one of each sequence, least cost of each."""
    starts = np.cumsum(sizes) - sizes
    letter, before, after, cost = np.zeros(len(kind), np.int8), np.zeros(len(kind), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for some in _runs(sizes):
        at = _take(starts[some], sizes[some])
        whole = Lattice(kind[at], n[at], sizes[some], AT_START[None], ACCEPTED[None], np.ones(len(some), bool))
        chosen, inserted, _ = whole.walk(np.ones(len(some), np.uint8))
        letter[at], before[at] = chosen[whole.inside], inserted[whole.inside]
        after[some], cost[some] = inserted[np.arange(len(some)), sizes[some]], whole.total
    return letter, before, after, cost


# ---- conversations of usual length ----------------------------------------------------------


def _edits_schema(conv: str) -> str:
    return f"conv_id {conv}, turn long, role string, digest binary, n long, letter string, before long, after long, illegal long, cost long"


def _whole(rows: DataFrame, conv: str) -> DataFrame:
    """Edits of conversations of at most ``SEGMENT`` rows; ``illegal`` and ``cost`` stand on the first row of each."""

    def edits(held: pa.Table) -> pa.RecordBatch:
        ids = held.column("conv_id").combine_chunks()
        first = np.flatnonzero(_changes(ids))
        sizes = np.diff(np.append(first, len(ids)))
        kind, n, role = (held.column(c).to_numpy() for c in ("kind", "n", "initial"))
        letter, before, after, cost = solve(kind, n, sizes)
        tail, bad, due = (np.zeros(len(ids), np.int64) for _ in range(3))
        tail[first + sizes - 1], bad[first], due[first] = after, _illegal(role, n, sizes), cost
        names = pa.array(np.array(list(LETTERS))[letter])
        columns = [held.column(c).combine_chunks() for c in ("conv_id", "turn", "role", "digest", "n")] + [names, *(pa.array(x) for x in (before, tail, bad, due))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _edits_schema(conv).split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            held = pa.table(b) if held is None else pa.concat_tables([held, pa.table(b)])
            first = np.flatnonzero(_changes(held.column("conv_id").combine_chunks()))
            if len(first) > 1 and held.num_rows >= CELLS // 4:
                yield edits(held.slice(0, first[-1]))
                held = held.slice(first[-1])
        if held is not None:
            yield edits(held)

    return sorted_by_conversation(rows, ORDER).mapInArrow(tidied(run), _edits_schema(conv))


def _changes(ids: pa.Array) -> np.ndarray:
    """Where an id differs from the one before; nulls are equal."""
    code = pa.compute.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.append(True, code[1:] != code[:-1])


def sorted_by_conversation(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", *order)]
    return rows.repartition(shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions(*keys)


# ---- conversations of any length ------------------------------------------------------------


def _stream(rows: DataFrame, order: Column, begin: Callable[[], object], step: Callable[[object, dict], tuple[object, tuple]], schema: str) -> DataFrame:
    """Folds the sorted rows of each conversation (one row a segment), giving a row for each."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                if last is None or last != (r["group"],):
                    last, state = (r["group"],), begin()
                state, row = step(state, r)
                out.append(row)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(shuffle_width(rows.sparkSession), "group").sortWithinPartitions("group", order).mapInPandas(run, schema)


def _segments(rows: DataFrame, conv: str, size: int) -> DataFrame:
    """Rows with ``group`` (a name of the conversation without nulls) and ``segment``, numbered in order; at most ``size`` rows each."""
    schema = f"conv_id {conv}, turn long, role string, digest binary, n long, kind int, initial int, group string, segment long, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, place, last = TaskContext.get().partitionId() << 32, -1, None
        for b in batches:
            if not b.num_rows:
                continue
            numbers, places = [], []
            for name in b.column("group").to_pylist():
                place += 1
                if name != last or place == size:
                    segment, place, last = segment + 1, 0, name
                numbers.append(segment)
                places.append(place)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64()), pa.array(places, pa.int64())], [c.split()[0] for c in schema.split(", ")])

    group = F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    named = rows.select("conv_id", *ORDER, "n", "kind", "initial", group.alias("group"))
    keys = ["group", *(F.col(c).asc_nulls_first() for c in ORDER)]
    return named.repartitionByRange(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(tidied(run), schema)


def _long(rows: DataFrame, conv: str, scratch: Scratch, size: int) -> DataFrame:
    """Edits of conversations of any number of rows, solved in segments."""
    cut = scratch.settle(_segments(rows, conv, size), "segments")

    def lattice(part: pd.DataFrame, start: np.ndarray, end: np.ndarray | None, last: bool) -> Lattice:
        times = len(start)
        kind, n = np.tile(part["kind"].to_numpy(), times), np.tile(part["n"].to_numpy(), times)
        return Lattice(kind, n, np.full(times, len(part)), start, end, np.full(times, last))

    def reduce(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        units = np.where(np.eye(4, dtype=bool), 0, FAR)
        matrix = lattice(part, units, None, False).before[:, -1]
        role = part["initial"].to_numpy()
        bad = int(_illegal(role, part["n"].to_numpy().copy(), np.array([len(part)]))[0])
        return pd.DataFrame([(part["group"].iloc[0], part["segment"].iloc[0], int(role[0]), int(role[-1]), bad, matrix.ravel().tolist())], columns=["group", "segment", "first", "last", "bad", "matrix"])

    parts = scratch.settle(cut.groupBy("group", "segment").applyInPandas(reduce, "group string, segment long, first int, last int, bad long, matrix array<long>"), "matrices")

    def onward(state, r):
        costs, role, bad = state
        matrix = np.array(r["matrix"]).reshape(4, 4)
        bad += r["bad"] + (role is not None and role * 4 + r["first"] not in _LEGAL)
        out = np.minimum((costs[:, None] + matrix).min(0), FAR)
        return (out, r["last"], bad), (r["group"], r["segment"], matrix.ravel().tolist(), costs.tolist(), int(bad), int((out + CLOSING).min()))

    there = _stream(parts, F.col("segment").asc(), lambda: (AT_START, None, 0), onward, "group string, segment long, matrix array<long>, start array<long>, bad long, closed long")

    def back(state, r):
        end, last = (ACCEPTED, True) if state is None else (state, False)
        matrix = np.array(r["matrix"]).reshape(4, 4)
        beyond = CLOSING if last else end
        return np.minimum((matrix + beyond).min(1), FAR), (r["group"], r["segment"], list(r["start"]), end.tolist(), last, r["bad"], r["closed"])

    borders = scratch.settle(_stream(there, F.col("segment").desc(), lambda: None, back, "group string, segment long, start array<long>, end array<long>, last boolean, bad long, closed long"), "borders")

    def border(facts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
        f = facts.iloc[0]
        return np.array(f["start"], np.int64), np.array(f["end"], np.int64), bool(f["last"])

    def sets(part: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        start, end, last = border(facts)
        masks = np.arange(16, dtype=np.uint8)
        _, _, left = lattice(part.sort_values("place"), np.tile(start, (16, 1)), np.tile(end, (16, 1)), last).walk(masks)
        return pd.DataFrame([(facts["group"].iloc[0], facts["segment"].iloc[0], left.astype(int).tolist())], columns=["group", "segment", "leaves"])

    keys = ["group", "segment"]
    leaves = cut.groupBy(*keys).cogroup(borders.groupBy(*keys)).applyInPandas(sets, "group string, segment long, leaves array<int>")
    entered = _stream(leaves, F.col("segment").asc(), lambda: 1, lambda mask, r: (int(r["leaves"][mask]), (r["group"], r["segment"], mask)), "group string, segment long, mask int")
    known = scratch.settle(borders.join(entered, keys), "entered")

    def letters(part: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        start, end, last = border(facts)
        part = part.sort_values("place")
        solved = lattice(part, start[None], end[None], last)
        letter, inserted, _ = solved.walk(np.array([facts["mask"].iloc[0]]))
        tail, bad, cost = (np.zeros(len(part), np.int64) for _ in range(3))
        if last:  # this one knows the whole conversation's
            tail[-1], bad[-1], cost[-1] = inserted[0, len(part)], facts["bad"].iloc[0], facts["closed"].iloc[0]
        return part[["conv_id", "turn", "role", "digest", "n"]].assign(letter=[LETTERS[x] for x in letter[0, : len(part)]], before=inserted[0, : len(part)], after=tail, illegal=bad, cost=cost)

    return cut.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(letters, _edits_schema(conv))


# ---- the whole operator ---------------------------------------------------------------------


def edits_of(rows: DataFrame, scratch: Scratch, segment: int = SEGMENT) -> DataFrame:
    """Edits of every distinct row: its letter, insertions before it, and after it where it is the last one."""
    conv = dict(rows.dtypes)["conv_id"]
    coded = with_kinds(rows)
    long = scratch.settle(rows.groupBy("conv_id").count().filter(F.col("count") > segment).select("conv_id"), "long")
    if long.isEmpty():
        return _whole(coded, conv)
    return _whole(join_by(coded, long, ["conv_id"], "left_anti"), conv).unionByName(_long(join_by(coded, long, ["conv_id"], "left_semi"), conv, scratch, segment))


def rebuilt(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit and repaired_sha256, from the sorted stream of edits and the texts they are about."""
    conv = dict(rows.dtypes)["conv_id"]
    texts = rows.filter("copies > 0").filter(F.rtrim(F.col("text"), F.lit(SPACES)) != "").select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), "text")
    both = edits.withColumn("what", F.lit(0)).unionByName(texts.withColumn("what", F.lit(1)), allowMissingColumns=True)
    names = ["conv_id", "illegal", "cost", "audit", "repaired_sha256"]

    class Open:
        def __init__(self):
            self.audit, self.sha, self.any, self.last, self.illegal, self.cost, self.due, self.after = [], hashlib.sha256(), False, "", 0, 0, None, 0

        def say(self, role: str, text: str) -> None:
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.any, self.last = True, role[:1]

        def other(self) -> str:
            return "assistant" if self.last == "u" else "user"

        def insert(self, times: int) -> None:
            self.audit.append("I" * times)
            for _ in range(times):
                self.say(self.other(), "")

        def edit(self, r: dict) -> None:
            self.settle_tail()
            self.illegal += r["illegal"]
            self.cost += r["cost"]
            self.insert(r["before"])
            self.audit.append(r["letter"] + "D" * (r["n"] - 1))
            self.due = {"K": r["role"], "R": self.other()}.get(r["letter"])
            self.after = r["after"]

        def text(self, text: str) -> None:
            if self.due is not None:
                role, self.due = self.due, None
                self.say(role, text)

        def settle_tail(self) -> None:
            times, self.after = self.after, 0
            self.insert(times)

        def row(self, conv_id) -> tuple:
            self.settle_tail()
            return conv_id, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def flushed(out: list[tuple]) -> pa.RecordBatch:
            kinds = [kind_of["conv_id"], pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        kind_of: dict = {}
        for b in batches:
            kind_of["conv_id"] = b.schema.field("conv_id").type
            out = []
            for r in b.to_pylist():
                if held is None or now != (r["conv_id"],):
                    if held is not None:
                        out.append(held.row(now[0]))
                    now, held = (r["conv_id"],), Open()
                if r["what"]:
                    held.text(r["text"])
                else:
                    held.edit(r)
            if out:
                yield flushed(out)
        if held is not None:
            yield flushed([held.row(now[0])])

    return sorted_by_conversation(both, (*ORDER, "what")).mapInArrow(tidied(run), f"conv_id {conv}, illegal long, cost long, audit string, repaired_sha256 string")


def repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row per conv_id of ``conversations``: faults, least cost, edits and digest of the repaired conversation."""
    scratch = Scratch(conversations.sparkSession, "conversations")
    rows = damaged(conversations)
    distinct = scratch.settle(distinct_rows(rows), "rows")
    marked = scratch.settle(with_faults(distinct), "faults")
    scratch.drop(distinct)
    solved = rebuilt(scratch.settle(edits_of(marked, scratch, segment), "edits"), rows)
    first_only = ~F.col("blank") & ~F.col("later")
    counted = marked.groupBy("conv_id").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("later"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum(F.when(first_only & F.col("truncated"), 1).otherwise(0)).alias("truncated"),
    )
    turns = marked.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    every = only(conversations, "conv_id").distinct()
    joined = join_by(join_by(join_by(every, turns, ["conv_id"]), counted, ["conv_id"]), solved, ["conv_id"])
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
