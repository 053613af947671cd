"""Conversation repair: equal to a brute-force twin and to exhaustive search, segments equal to whole conversations, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from siltstone.llm import conversations as C
from siltstone.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string, kind string, n string, digest string, later string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Least (cost, audit, repaired rows) by a plain forward pass over (what the roles end in)."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    states = {"": (0, "", ())}

    def relax(into, key, value):
        if key not in into or value[:2] < into[key][:2]:
            into[key] = value

    def inserted(states):
        for _ in range(3):
            for q, (c, e, o) in list(states.items()):
                relax(states, follow[q], (c + 5, e + "I", (*o, names[follow[q]] + ":")))
        return states

    for (_, _, role, text), kind in zip(rows, kinds, strict=True):
        new = {}
        due = 5 * (kind == "truncated")
        for q, (c, e, o) in inserted(states).items():
            relax(new, q, (c + 2, e + "D", o))
            if kind not in ("blank", "duplicate"):
                relax(new, follow[q], (c + 1 + due, e + "R", (*o, f"{names[follow[q]]}:{text}")))
                x = role[:1]
                if x and (x == follow[q] or (x == "s" and q == "")):
                    relax(new, x, (c + due, e + "K", (*o, f"{role}:{text}")))
        states = new
    return min(v for q, v in inserted(states).items() if q in ("", "a"))


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = [r for r in damage(rows) if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()[:16]))
        kinds = faults(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, repaired = cheapest(mine, kinds)
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(parts)
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r[c] for c in names) for r in C.repair(df, **kw).collect()), key=lambda r: (r[0] is None, r[0] or 0))


def random_rows(seed, conversations=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, rng.choice([f"Words {turn}.", "Same.", "cut off", "", " \t", None, "Ends! \n", "漢字。", "yes?"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = random_rows(seed)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed, segment", [(4, 1), (5, 2), (6, 5)])
def test_segments_equal_whole_conversations(spark, seed, segment):
    rows = random_rows(seed, 12, 40)
    assert run(spark, rows, segment=segment) == brute(rows)


def test_exhaustive_search_over_all_audits():
    """Every string of edits of short sequences: the lattice finds the least cost and the least string of that cost."""
    rng = np.random.default_rng(0)
    initials = "sua?"

    def score(audit, kinds):
        """Cost of an audit, or None if no choice of roles makes it lawful."""
        states, i, cost = {""}, 0, 0
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}
        for letter in audit:
            if letter == "I":
                states, cost = {follow[q] for q in states}, cost + 5
                continue
            if i == len(kinds):
                return None
            kind, i = kinds[i], i + 1
            if letter == "D":
                cost += 2
            elif kind == 8:
                return None
            else:
                cost += 5 * (kind // 4) + (letter == "R")
                x = initials[kind % 4]
                states = {follow[q] for q in states} if letter == "R" else {x for q in states if x == follow[q] or (x == "s" and q == "")}
        return cost if i == len(kinds) and states & {"", "a"} else None

    for _ in range(40):
        kinds = rng.choice([0, 1, 2, 3, 4, 5, 6, 8], rng.integers(1, 5))
        best = min((c, a) for k in range(len(kinds), len(kinds) + 3) for a in map("".join, itertools.product("DIKR", repeat=k)) if (c := score(a, kinds)) is not None)
        letter, before, after, cost = C.solve(kinds, np.ones(len(kinds), np.int64), np.array([len(kinds)]))
        audit = "".join("I" * b + C.LETTERS[x] for b, x in zip(before, letter, strict=True)) + "I" * after[0]
        assert (cost[0], audit) == best


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hello."), (7, None, "assistant", "Yes."), (8, 1, "user", "x" * 50_000 + "."), (8, 2, "assistant", "."), (9, 5, "usr", "Other u."), (9, 6, "all", "Other a.")]
    rows += [(7, None, "assistant", "Yes.")] * 3
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    dropped = next((c, 0, "user", "Gone.") for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [dropped]) == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"Row {t}.") for t in range(3000)] + [(1, 5, "user", "Again and again.")] * 500 + random_rows(9)
    rows = [r for r in rows if r[0] != 1 or r[3].startswith(("Row", "Again"))]
    assert run(spark, rows, segment=700, parts=7) == brute(rows)


def test_query_equals_sql(spark, small, same_rows):
    same_rows(Q.op11_conversation_repair(spark, small), Q.OP11_SQL)
