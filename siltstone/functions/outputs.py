"""Model output and review files: labelled fields, quotes, nested records, marked decisions, placeholders."""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from functools import cached_property
from typing import Any

import numpy as np

#: Labels of an output, the token of absence, and the issues that make an output partial.
LABELS = ("REASONING", "ANSWER", "CITATIONS", "QUOTES", "CONFIDENCE")
ABSENT_TOKENS = ("not_in_documents", "not in documents")
PARTIAL = ("missing_", "citations_unparseable", "confidence_unparseable", "quotes_unparseable", "empty_reasoning", "empty_citations")
_EMPHASIS = "*_"
_BLANK = " \t"
_QUOTE_MARKS = "\"'“”‘’"


def _label(line: str, heading: bool = True) -> tuple[str, str] | None:
    """The label that a line begins with, whatever its case and emphasis, and what stands behind it."""
    rest = line.lstrip(_BLANK)
    if heading and 0 < len(rest) - len(rest.lstrip("#")) <= 6:
        rest = rest.lstrip("#").lstrip(_BLANK)
    rest = rest.lstrip(_EMPHASIS + _BLANK)
    name = next((x for x in LABELS if rest[: len(x)].upper() == x), None)
    if name is None:
        return None
    behind = rest[len(name) :].lstrip(_EMPHASIS + _BLANK)
    return (name, behind[1:].lstrip(_BLANK).lstrip(_EMPHASIS)) if behind.startswith(":") else None


def sections(text: str) -> tuple[dict[str, str], list[str]]:
    """Text behind each label up to the next; of repeated labels the last counts; what is out of order is reported."""
    found: dict[str, list[str]] = {}
    issues: list[str] = []
    into: list[str] | None = None
    early = False
    for line in text.split("\n"):
        mark = _label(line)
        if mark is None:
            early |= into is None and bool(line.strip())
            if into is not None:
                into.append(line)
        while mark is not None:  # a label right behind another leaves that one empty
            name, rest = mark
            mark = _label(rest, heading=False)
            if mark is not None:
                issues.append(f"empty_{name.lower()}_chained")
            if name in found:
                issues.append(f"duplicate_{name.lower()}")
            into = found[name] = [] if mark is not None else [rest]
    if found and early:
        issues.append("text_before_first_field")
    return {name: "\n".join(lines).strip() for name, lines in found.items()}, issues


def _bare(text: str) -> str:
    return text.strip().strip(_EMPHASIS).strip()


def _numbers_behind_c(text: str) -> list[int]:
    """The numbers of all words C1, c02, ... in order, each once."""
    words = "".join(c if c.isalnum() or c == "_" else " " for c in text).split()
    return list(dict.fromkeys(int(w[1:]) for w in words if w[0] in "cC" and w[1:].isdecimal()))


def _none(text: str) -> bool:
    return text.strip(_EMPHASIS + ". \t\n").lower() in ("none", "n/a", "na")


def _quote_lines(text: str) -> list[dict[str, Any]]:
    """Quotes, one a line as ``C2: "words"``; lines without a label go on with the quote before."""
    out: list[dict[str, Any]] = []
    for line in text.splitlines():
        head, colon, words = line.strip().removeprefix("-").removeprefix("*").strip().partition(":")
        label = head.strip().removeprefix("[").removesuffix("]")
        if colon and words.strip() and label[:1] in ("c", "C") and label[1:].isdecimal():
            out.append({"label": int(label[1:]), "text": words.strip()})
        elif line.strip() and out:
            out[-1]["text"] += "\n" + line.strip()
    return [q | {"text": q["text"].strip().strip(_QUOTE_MARKS).strip()} for q in out]


def _percentage(text: str) -> int | None:
    """A whole number up to 100, which a percent sign or ``/100`` may follow."""
    number = "".join(text.split()).removesuffix("/100").removesuffix("%")
    return int(number) if number.isdecimal() and len(number) <= 3 and int(number) <= 100 else None


def parse_output(text: str, n_chunks: int, requested: tuple[str, ...] = ("ANSWER", "CITATIONS", "CONFIDENCE")) -> dict[str, Any]:
    """Fields of a model's output, what is wrong with it, and the state of the whole: ok, partial or failed."""
    found, issues = sections(text)
    issues += sorted(f"unrequested_{x.lower()}" for x in found if x not in requested)
    answer = _bare(found.get("ANSWER", "")) or None
    said = " ".join("".join(c if c.isalnum() or c == "_" else " " for c in (text if answer is None else answer).lower()).split())
    out: dict[str, Any] = {"status": "failed", "answer": answer, "citations": [], "invalid_citations": [], "quotes": [], "confidence": None, "reasoning": None}
    out["abstained"] = any(f" {t} " in f" {said} " for t in ABSENT_TOKENS)
    if answer is None:
        return out | {"issues": [*issues, "missing_answer"]}
    issues += [f"missing_{x.lower()}" for x in LABELS if x in requested and x not in found]
    if (body := found.get("CITATIONS")) is not None:
        cited = _numbers_behind_c(body)
        out["citations"] = [c for c in cited if 1 <= c <= n_chunks]
        out["invalid_citations"] = [c for c in cited if not 1 <= c <= n_chunks]
        checks = {"citation_out_of_range": bool(out["invalid_citations"]), "empty_citations": not body and "empty_citations_chained" not in issues, "citations_unparseable": bool(body) and not cited and not _none(body)}
        issues += [name for name, wrong in checks.items() if wrong]
    if (body := found.get("QUOTES")) is not None:
        quotes = out["quotes"] = _quote_lines(body)
        checks = {"quotes_unparseable": bool(body) and not quotes and not _none(body), "quote_for_uncited_label": bool({q["label"] for q in quotes} - set(out["citations"])), "citations_without_quotes": bool(out["citations"]) and not quotes}
        issues += [name for name, wrong in checks.items() if wrong]
    if (body := found.get("CONFIDENCE")) is not None:
        first, _, more = body.partition("\n")
        out["confidence"] = _percentage(_bare(first))
        issues += ["confidence_unparseable"] * (out["confidence"] is None) + ["text_after_confidence"] * bool(more)
    if (body := found.get("REASONING")) is not None:
        out["reasoning"] = body
        issues += ["empty_reasoning"] * (not body)
    return out | {"status": "partial" if any(i.startswith(PARTIAL) for i in issues) else "ok", "issues": issues}


def _norm(text: str) -> str:
    return re.sub("[^a-z0-9]", "", text.lower())


#: Runs of a quote that count are at least so long; so much of it must stand in them.
RUN, SHARE = 8, 0.9
#: Pairs of equal grams, for each character, beyond which runs are found by ranks.
CROWDED = 32


class Excerpt:
    """A text that quotes are held against, normalised once."""

    def __init__(self, text: str):
        self.text = _norm(text)

    @cached_property
    def grams(self) -> list[str]:
        return _grams(self.text)

    @cached_property
    def known(self) -> set[str]:
        return set(self.grams)


def _grams(text: str) -> list[str]:
    return [text[i : i + RUN] for i in range(len(text) - RUN + 1)]


class _Ranks:
    """Longest common runs by ranks of substrings of 1, 2, 4, ... characters, for texts that repeat themselves."""

    def __init__(self, own: str, quote: str):
        codes = np.frombuffer((own + "\0" + quote).encode("ascii"), np.uint8)
        self.tables, self.shift = [np.unique(codes, return_inverse=True)[1].astype(np.int64)], len(own) + 1
        while 2 << (len(self.tables) - 1) <= min(len(own), len(quote)):
            self.tables.append(np.unique(self._pairs(2 << (len(self.tables) - 1)), return_inverse=True)[1].astype(np.int64))

    def _pairs(self, size: int) -> np.ndarray:
        """Numbers that are equal where substrings of this size are: those of its beginning and its end."""
        k = min(size.bit_length() - 1, len(self.tables) - 1)
        rank = self.tables[k]
        last = size - (1 << k)
        return rank[: len(rank) - last] * len(self.tables[0]) + rank[last:]

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        low, high, found = RUN, min(ahi - alo, bhi - blo), (alo, blo, 0)
        while low <= high:
            size = (low + high) // 2
            key = self._pairs(size)
            a, b = key[alo : ahi - size + 1], key[self.shift + blo : self.shift + bhi - size + 1]
            met = np.flatnonzero(np.isin(a, b))
            if len(met):
                found, low = (alo + int(met[0]), blo + int(np.argmax(b == a[met[0]])), size), size + 1
            else:
                high = size - 1
        return found


def _is_near(own: Excerpt, quote: str) -> bool:
    """Whether ``SHARE`` of a quote stands in runs of ``RUN`` characters: the longest common run first, then what is left and right of it.

    The runs are those of ``difflib.SequenceMatcher.get_matching_blocks``; shorter ones are not
    looked for.  Most quotes are settled by the grams that they share with the text.
    """
    grams = _grams(quote)
    covered = np.zeros(len(quote) + RUN, np.int64)
    shared = np.flatnonzero([g in own.known for g in grams])
    np.add.at(covered, shared, 1)
    np.add.at(covered, shared + RUN, -1)
    if np.count_nonzero(np.cumsum(covered)[: len(quote)]) < SHARE * len(quote):
        return False
    matcher = difflib.SequenceMatcher(None, own.grams, grams, autojunk=False)
    times = Counter(grams)
    if sum(times[g] for g in own.grams if g in times) > CROWDED * (len(own.text) + len(quote)):
        longest = _Ranks(own.text, quote).longest
    else:

        def longest(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
            i, j, n = matcher.find_longest_match(alo, ahi - RUN + 1, blo, bhi - RUN + 1)
            return i, j, n and n + RUN - 1

    total, rest = 0, [(0, len(own.text), 0, len(quote))]
    while rest and total < SHARE * len(quote):
        alo, ahi, blo, bhi = rest.pop()
        if min(ahi - alo, bhi - blo) < RUN:
            continue
        i, j, n = longest(alo, ahi, blo, bhi)
        if n:
            total += n
            rest += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
    return total >= SHARE * len(quote)


def quote_status(quote: str, own: str | Excerpt, others: list[str | Excerpt]) -> str:
    """exact, near (nine tenths in runs of eight at least), other_excerpt, not_found or empty."""
    q = _norm(quote)
    if not q:
        return "empty"
    own, *others = (t if isinstance(t, Excerpt) else Excerpt(t) for t in (own, *others))
    if q in own.text:
        return "exact"
    if _is_near(own, q):
        return "near"
    return "other_excerpt" if any(q in o.text for o in others) else "not_found"


def quote_fidelity(quotes: list[dict[str, Any]], chunks: dict[int, str]) -> dict[str, Any]:
    """State of every quote against the chunk of its label and the others, and the shares that are faithful and exact."""
    texts = {k: Excerpt(t) for k, t in chunks.items()}
    states = [quote_status(q["text"], texts.get(q["label"], ""), [t for k, t in texts.items() if k != q["label"]]) for q in quotes]
    share = lambda *good: sum(s in good for s in states) / len(states) if states else None
    return {"n_quotes": len(states), "states": states, "faithful_rate": share("exact", "near"), "exact_rate": share("exact")}


def lookup(record: Any, path: str) -> Any:
    """Value at a dotted path, or None."""
    for key in path.split("."):
        if isinstance(record, dict):
            record = record.get(key)
        elif isinstance(record, list) and key.isdigit() and int(key) < len(record):
            record = record[int(key)]
        else:
            return None
    return record


def flatten(record: Any, prefix: str = "") -> dict[str, float]:
    """Numeric leaves by dotted key; pairs named ci95 become ``_lo`` and ``_hi``; flags and non-finite numbers go."""
    if isinstance(record, dict):
        out: dict[str, float] = {}
        for key, value in record.items():
            name = f"{prefix}.{key}" if prefix else str(key)
            if key == "ci95" and isinstance(value, list) and len(value) == 2:
                out |= flatten(value[0], name + "_lo") | flatten(value[1], name + "_hi")
            else:
                out |= flatten(value, name)
        return out
    if isinstance(record, list):
        return {k: v for i, x in enumerate(record) for k, v in flatten(x, f"{prefix}.{i}").items()}
    good = isinstance(record, (int, float)) and not isinstance(record, bool) and math.isfinite(record)
    return {prefix: float(record)} if good else {}


def parse_review(text: str) -> list[dict[str, Any]]:
    """Items of a review file: the one marked option, the comment, and what is wrong."""
    out = []
    for part in re.split(r"(?m)^## ", text)[1:]:
        head, _, body = part.partition("\n")
        marked = re.findall(r"\[(x|X| )\]\s*([\w-]+)", body)
        chosen = [o for m, o in marked if m.lower() == "x"]
        comment = re.search(r"(?m)^comment:[ \t]*(.*)$", body)
        problem = None if len(chosen) == 1 else "none marked" if not chosen else "several marked"
        out.append({"item": head.strip(), "decision": chosen[0] if len(chosen) == 1 else None, "comment": comment[1].strip() if comment else "", "problem": problem})
    return out


def render(template: str, values: dict[str, str]) -> str:
    """Placeholders replaced once; an unknown one is an error."""
    return re.sub(r"\{\{(\w+)\}\}", lambda m: values[m[1]], template)


def two_decimals(number: float) -> str:
    """The number with two decimals: its hundredfold rounded half away from zero, minus zero as ``-0.00``."""
    hundredfold = number * 100
    if math.isfinite(hundredfold):
        size = abs(hundredfold)
        number = math.copysign(math.floor(size) + (size - math.floor(size) >= 0.5), hundredfold) / 100
    return f"{number:.2f}"


def typed_literals(template: str) -> list[str]:
    """Numbers written into a template instead of being placeholders."""
    return re.findall(r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])", re.sub(r"\{\{\w+\}\}", "", template))
