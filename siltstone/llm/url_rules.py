"""URL filter: a trie over reversed host labels and path segments, broadcast to the executors.

The rule table is small by contract: it is refused above ``max_rules`` entries, which
bounds what is broadcast.  A rule ``host/path`` fits its host and every subdomain when
the URL's path starts with the rule's path; of the fitting rules that with the most host
labels wins, then that with the longest path, then ``block`` before ``allow``.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule
and the default verdict; an empty path fits no rule (every rule path starts with ``/``);
repeated rows are judged one by one; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, tidied

MAX_RULES = 100_000
Rule = tuple[str, str]


def host_of(url):
    """Host column: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.substring_index(_after_scheme(url), "/", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    """Path column: what follows the host up to ``?``, ``#`` or the end."""
    plain = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    at = F.locate("/", plain)
    return F.when(at > 0, F.substring(plain, at, F.length(plain))).otherwise("")


def _after_scheme(url):
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


class RuleTrie:
    """Host labels from the right, then path segments; a partly written last segment is kept as a prefix.

    A node is ``[children by label, path node]``, a path node ``[children by segment, open
    endings, verdict]``: an ending is what follows the last ``/`` of a rule, so ``/en/1``
    ends in the node of ``/en/`` with the open ending ``1``.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: list = [{}, None]
        for rule, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r} of rule {rule!r}")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}]
            *segments, last = ("/" + path if slash else "/").split("/")[1:]
            spot = node[1]
            for s in segments:
                spot = spot[0].setdefault(s, [{}, {}])
            if spot[1].get(last, ("", "allow"))[1] != "block":
                spot[1][last] = (rule, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        if not path.startswith("/"):
            return None
        node, best, spots = self.root, None, []
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                spots.append(node[1])
        for spot in reversed(spots):
            best = self._longest(spot, path)
            if best is not None:
                return best
        return None

    @staticmethod
    def _longest(spot: list, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")[1:]
        for i, segment in enumerate(segments):
            fits = [e for e in spot[1] if segment.startswith(e)]
            if fits:
                best = spot[1][max(fits, key=len)]
            if i == len(segments) - 1:
                break
            spot = spot[0].get(segment)
            if spot is None:
                break
        return best


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_rules: int = MAX_RULES) -> DataFrame:
    """(id, host, path, rule, verdict) of every row. ``rules``: (``host/path``, ``allow`` or ``block``)."""
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules exceed the broadcast bound of {max_rules}")
    trie = RuleTrie(rules)
    shared = pages.sparkSession.sparkContext.broadcast(trie)
    parts = only(pages, id_col, url_col).select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts = parts.fillna("", ["host", "path"])
    kind = dict(parts.dtypes)[id_col]

    def judge(batches):
        known = shared.value
        for b in batches:
            found = [known.find(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            rule = pa.array([f[0] if f else None for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], [*b.schema.names, "rule", "verdict"])

    return parts.mapInArrow(tidied(judge), f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
