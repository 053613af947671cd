"""Column functions over numbers: tolerance, readings of a figure, formats, costs, guarded statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def within(predicted: Column, gold: Column, rel_tol: float, decimals: Column) -> Column:
    """Difference within the relative tolerance or half a unit of the gold's last decimal."""
    slack = F.greatest(F.lit(rel_tol) * F.abs(gold), F.lit(0.5) * F.pow(F.lit(10.0), -decimals))
    return F.abs(predicted - gold) <= slack * (1 + 1e-9) + 1e-12


def readings(number: Column, percent: Column, scale: Column, explicit: Column, gold_percent: Column, unit: Column) -> Column:
    """Values that a written figure may stand for, in the gold's unit."""
    value = number * scale
    return (
        F.when(gold_percent & percent, F.array(number))
        .when(gold_percent & explicit, F.array(value))
        .when(gold_percent, F.array(number, number * 100))
        .when(percent, F.array(number / 100 / unit))
        .when(explicit, F.array(value / unit))
        .when(unit == 1, F.array(number))
        .otherwise(F.array(number, number / unit))
    )


def token_bound(text: Column) -> Column:
    """An upper bound of the tokens of a text."""
    return F.floor(F.length(text) / 1.5).cast("bigint") + 1


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, batch: Column) -> Column:
    """Price of a call; prices are for a million tokens, batches cost half."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6 * F.when(batch, 0.5).otherwise(1.0)


def quadrant(correct: Column, grounded: Column) -> Column:
    """The four combinations of two flags; null where either is undefined."""
    side = lambda flag, yes: F.when(flag, yes).otherwise(f"not_{yes}")
    return F.when(correct.isNotNull() & grounded.isNotNull(), F.concat_ws("_", side(correct, "correct"), side(grounded, "grounded")))


def is_correct(label: Column, lenient: bool = False) -> Column:
    """True, false, or null for labels that are no grades."""
    good = ["correct", "partially_correct"] if lenient else ["correct"]
    bad = ["incorrect", "unit_error"] if lenient else ["incorrect", "unit_error", "partially_correct"]
    return F.when(label.isin(good), True).when(label.isin(bad), False)


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the pairs; null below three or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    fine = (F.count(a) >= 3) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    # The ratio is taken behind the guard: without variance the built-in one divides by zero.
    return F.when(fine, F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def interval_reading(grounded: tuple[Column, Column], precision: tuple[Column, Column]) -> Column:
    """Reads two confidence intervals of differences together."""
    (glo, ghi), (_, phi) = grounded, precision
    return (
        F.when(glo.isNull(), "undetermined")
        .when(glo > 0, "real_improvement")
        .when(ghi < 0, "worse")
        .when(phi < 0, "apparent_only")
        .otherwise("no_effect")
    )


def formatted(value: Column, kind: str, digits: int = 2) -> Column:
    """A number as text: f (fixed), pct (percent), pp (points), usd; no negative zero, a true minus sign."""
    scaled = F.round(value * 100 if kind in ("pct", "pp") else value, digits)
    plain = F.format_string(f"%.{digits}f", F.abs(scaled))
    sign = F.when(scaled < 0, "−").otherwise("+" if kind == "pp" else "")
    tail = {"pct": "%", "pp": " pp"}.get(kind, "")
    return F.when(value.isNotNull(), F.concat(sign, F.lit("$" if kind == "usd" else ""), plain, F.lit(tail)))
