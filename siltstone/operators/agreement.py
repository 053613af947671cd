"""Agreement, correlation and overlap statistics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cohen_kappa(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """n, raw agreement and Cohen's kappa of two raters by group.

    Only the contingency table leaves the first aggregate, so the cost after one pass is
    that of the labels squared.  Kappa is null for no pairs and where chance agreement is 1.
    """
    by = list(by)
    cells = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).count()
    rows = Window.partitionBy(*by, "a") if by else Window.partitionBy("a")
    cols = Window.partitionBy(*by, "b") if by else Window.partitionBy("b")
    margins = cells.withColumn("ra", F.sum("count").over(rows)).withColumn("rb", F.sum("count").over(cols))
    # Chance agreement: every label's share with one rater times that with the other.
    left = margins.groupBy(*by, F.col("a").alias("label")).agg(F.max("ra").alias("ra"))
    right = margins.groupBy(*by, F.col("b").alias("label")).agg(F.max("rb").alias("rb"))
    chance = left.join(right, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("ra") * F.col("rb")).alias("both"))
    total = cells.groupBy(*by).agg(F.sum("count").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("count")).otherwise(0)).alias("same"))
    joined = total.join(chance, by, "left") if by else total.crossJoin(F.broadcast(chance))
    po, pe = F.col("same") / F.col("n"), F.coalesce("both", F.lit(0)) / (F.col("n") * F.col("n"))
    return joined.select(*by, "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def kappa_of_counts(cells: DataFrame, a: str, b: str, count: str, by: Sequence[str]) -> DataFrame:
    """Cohen's kappa from contingency tables, a row for each cell, by group; null for empty tables and where chance agreement is 1."""
    by = list(by)
    side = lambda label, name: cells.groupBy(*by, F.col(label).alias("_l")).agg(F.sum(count).alias(name))
    chance = side(a, "_ra").join(side(b, "_rb"), [*by, "_l"]).groupBy(*by).agg(F.sum(F.col("_ra") * F.col("_rb")).alias("_both"))
    total = cells.groupBy(*by).agg(F.sum(count).alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col(count)).otherwise(0)).alias("_same"))
    po, pe = F.col("_same") / F.col("n"), F.coalesce("_both", F.lit(0)) / (F.col("n") * F.col("n"))
    return total.join(chance, by, "left").select(*by, "n", F.when(F.col("n") > 0, po).alias("agreement"), F.when((F.col("n") > 0) & (pe < 1 - 1e-12), (po - pe) / (1 - pe)).alias("kappa"))


def confusion(pairs: DataFrame, a: str, b: str, labels: DataFrame) -> DataFrame:
    """Dense label by label counts, zeros included; ``labels`` has the column label."""
    grid = labels.select(F.col("label").alias(a)).crossJoin(F.broadcast(labels.select(F.col("label").alias(b))))
    counts = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    return grid.join(counts, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def mid_ranks(rows: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1-based ranks in which ties share their mean: counts by value, then a running sum over the distinct values."""
    by = list(by)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(value) if by else Window.orderBy(value)
    ranked = counts.withColumn(name, F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.select(*by, value, (F.coalesce(name, F.lit(0)) + (F.col("_n") + 1) / 2.0).alias(name))
    return rows.join(ranked, [*by, value])


def jaccard(a: Column, b: Column) -> Column:
    """Rows with both flags over rows with either; null where neither occurs."""
    both, either = F.count_if(a & b), F.count_if(a | b)
    return F.when(either > 0, both / either)
