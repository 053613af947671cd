"""The draws of ``operators/resampling.py`` as SQL: common table expressions that weigh units by Poisson numbers."""

from __future__ import annotations

from ..operators import resampling as S

#: Resamples of every bootstrap and permutation.
RESAMPLES = 10_000


def _xor_shift(x: str, by: int) -> str:
    return f"xor({x}, {x} >> {by})"


def draws_sql(name: str, source: str, x: str, keep: str) -> str:
    """CTEs that end in ``name``: the rows of ``source`` with ``drawn``, the mixed value of x (a UBIGINT below 2^32)."""
    return f"""{name}1 AS (SELECT {keep}, {_xor_shift('x', 16)} * 2146121005 % 4294967296 AS x FROM (SELECT {keep}, ({x})::UBIGINT AS x FROM {source})),
{name}2 AS (SELECT {keep}, {_xor_shift('x', 15)} * 2221713035 % 4294967296 AS x FROM {name}1),
{name} AS (SELECT {keep}, {_xor_shift('x', 16)} AS drawn FROM {name}2)"""


def seeds_sql(seed: int) -> str:
    """CTEs that end in ``seeded``: a number for each resample b."""
    return draws_sql("sd", f"(SELECT unnest(range({RESAMPLES})) AS b)", f"(b + {seed * 2654435761 % 2**32}) % 4294967296", "b") + ", seeded AS (SELECT b, drawn AS s FROM sd)"


def draw_sql(seed: int, units: str, by: str, key: str) -> str:
    """CTEs that end in ``rep``: the mean of every group in each resample, units weighted by Poisson numbers."""
    weight = " + ".join(f"(drawn >= {bar})::INT" for bar in S.POISSON)
    return f"""{seeds_sql(seed)}, un AS (SELECT {by}, ('0x' || substr(md5({key}::VARCHAR), 1, 8))::UBIGINT AS h, total, weight FROM {units}),
{draws_sql('dw', '(SELECT un.*, b, s FROM un, seeded)', 'xor(s, h)', f'{by}, b, total, weight')},
rep AS (SELECT {by}, b, sum(w * total) / nullif(sum(w * weight), 0) AS mean FROM (SELECT *, {weight} AS w FROM dw) GROUP BY ALL)"""
