"""Bootstrap and permutation from small states that tasks add up.

Bootstrap weights are Poisson numbers of mean 1 for each unit (a cluster reduced to its sums)
and resample, taken from a hash of seed, resample and unit: they are the same whatever the
partitioning and can be repeated by any engine.  A task turns its units into one array of
sums a group, and arrays are added; no row is made for a unit and a resample.

A permutation of flags within strata only changes the count of rows with both flags, so a
stratum is its two margins, and a permutation is a draw of that count (hypergeometric).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import md5_int
from .agreement import kappa_of_counts

#: A draw is below this number; ``POISSON`` are the draws from which a weight is at least 1, 2, ...
DRAWS = 1 << 32
POISSON = tuple(int(DRAWS * math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12))
#: Cells (a unit and a resample) weighted in one go, and groups whose sums a task holds.
CELLS, GROUPS = 1 << 20, 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers (held in 64 bits) whose values look random."""
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(0x7FEB352D)) & np.uint64(DRAWS - 1)
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(0x846CA68B)) & np.uint64(DRAWS - 1)
    return x ^ (x >> np.uint64(16))


def seeds(seed: int, resamples: int) -> np.ndarray:
    """A number for each resample, with which those of the units are combined by XOR."""
    return mixed((np.arange(resamples, dtype=np.uint64) + np.uint64(seed * 2654435761 % DRAWS)) & np.uint64(DRAWS - 1))


def weights(units: np.ndarray, of_resamples: np.ndarray) -> np.ndarray:
    """Poisson weight of every unit (a 32-bit number) in every resample."""
    drawn = mixed(of_resamples[None, :] ^ units.astype(np.uint64)[:, None])
    out = np.zeros(drawn.shape, np.float64)
    for bar in POISSON:
        more = drawn >= np.uint64(bar)
        if not more.any():
            break
        out += more
    return out


def resample_sums(units: DataFrame, key: str, by: Sequence[str], seed: int, resamples: int, sums: Sequence[str] = ("total", "weight")) -> DataFrame:
    """Sums of the columns ``sums`` of every group in each resample b, a unit counting as often as its weight says; nulls add nothing.

    A task holds ``GROUPS`` groups of ``resamples`` sums; one such state of each task and
    group is shuffled, and added to the others of its group one by one.
    """
    by = list(by)
    kinds = dict(units.dtypes)
    group = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"}) if by else F.lit("{}")
    flat = units.select(group.alias("g"), md5_int(F.col(key).cast("string")).alias("u"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(sums)])
    names = ["g", "state"]

    def state(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v.tobytes() for v in held.values()], pa.binary())], names)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held = seeds(seed, resamples), {}
        step = max(1, CELLS // resamples)
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column("g").dictionary_encode()
            place, groups = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            order = np.argsort(place, kind="stable")
            unit, place = b.column("u").to_numpy()[order], place[order]
            values = np.stack([b.column(f"s{i}").to_numpy()[order] for i in range(len(sums))])
            edges = np.searchsorted(place, np.arange(len(groups) + 1))
            for g, low, high in zip(groups, edges[:-1], edges[1:], strict=True):
                total = held.setdefault(g, np.zeros((len(sums), resamples)))
                for i in range(low, high, step):
                    some = slice(i, min(i + step, high))
                    total += values[:, some] @ weights(unit[some], base)
                if len(held) >= GROUPS:
                    yield state(held)
                    held = {}
        if held:
            yield state(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(0)

        def rows() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([last] * resamples), pa.array(np.arange(resamples, dtype=np.int32)), *(pa.array(x) for x in total)], ["g", "b", *(f"s{i}" for i in range(len(sums)))])

        for b in batches:
            for g, raw in zip(b.column("g").to_pylist(), b.column("state"), strict=True):
                values = np.frombuffer(raw.as_buffer(), np.float64).reshape(len(sums), resamples)
                if g == last:
                    total += values
                    continue
                if last is not None:
                    yield from rows()
                last, total = g, values.copy()
        if last is not None:
            yield from rows()

    columns = ", ".join(f"s{i} double" for i in range(len(sums)))
    states = flat.mapInArrow(weigh, "g string, state binary")
    added = states.repartition("g").sortWithinPartitions("g").mapInArrow(add, f"g string, b int, {columns}")
    told = [F.from_json("g", ", ".join(f"`{c}` {kinds[c]}" for c in by)).alias("_g")] if by else []
    named = added.select(*told, "b", *[F.col(f"s{i}").alias(c) for i, c in enumerate(sums)])
    return named.select(*[F.col(f"_g.`{c}`").alias(c) for c in by], "b", *sums)


def _width(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def resampled(units: DataFrame, key: str, by: Sequence[str], seed: int, resamples: int) -> DataFrame:
    """``resamples`` draws with replacement from the units of every group: the columns of a unit with the draw's number b.

    Units are numbered by their key; draw (b, j) takes the unit whose number is the hash
    modulo the number of units.
    """
    by = list(by)
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    numbered = units.withColumn("_j", F.row_number().over(w.orderBy(key)) - 1).withColumn("_k", F.count("*").over(w))
    # Few rows stand for many draws: they are dealt out by number, not by size.
    draws = numbered.select(*by, "_j", "_k").repartition(_width(units), *by, "_j").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    draws = draws.select(*by, "b", (md5_int(F.lit(str(seed)), F.col("b").cast("string"), F.col("_j").cast("string")) % F.col("_k")).cast("int").alias("_j"))
    return draws.join(numbered.drop("_k"), [*by, "_j"]).drop("_j")


def resample_means(units: DataFrame, key: str, by: Sequence[str], seed: int, resamples: int) -> DataFrame:
    """Means of ``resamples`` resamples of the units of every group; null where all weights are 0.

    ``units`` has one row per cluster with the columns total and weight (sum and count of
    its members).
    """
    drawn = resample_sums(units, key, by, seed, resamples)
    return drawn.select(*by, "b", F.when(F.col("weight") > 0, F.col("total") / F.col("weight")).alias("mean"))


def resample_kappas(pairs: DataFrame, a: str, b: str, key: str, by: Sequence[str], seed: int, resamples: int) -> DataFrame:
    """Cohen's kappa of two raters in every resample of the clusters ``key``: contingency tables are resampled, not rows."""
    by = list(by)
    cells = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, key, F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b")).agg(F.count("*").alias("total"))
    drawn = resample_sums(cells, key, [*by, "_a", "_b"], seed, resamples, ("total",))
    return kappa_of_counts(drawn, "_a", "_b", "total", [*by, "b"]).select(*by, "b", F.col("kappa").alias("mean"))


def percentile_interval(replicates: DataFrame, by: Sequence[str], value: str = "mean", **more: Column) -> DataFrame:
    """95 % interval by linear percentiles; undefined replicates are dropped and counted.  ``more``: other aggregates of the same groups, by name."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.groupBy(*by).agg(q.alias("q"), F.count_if(F.col(value).isNull()).alias("n_undefined"), *(c.alias(n) for n, c in more.items())).select(*by, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "n_undefined", *more)


def hypergeometric(n: int, first: int, second: int, drawn: np.ndarray) -> np.ndarray:
    """Counts of rows with both flags by the inverse distribution at ``drawn`` (from 0 to 1), given both margins of n rows.

    Counts further than 40 standard deviations from the mean are left out of the table.
    """
    low, high = max(0, first + second - n), min(first, second)
    if low == high or n < 2:
        return np.full(len(drawn), low)
    mean = first * second / n
    far = 40 * math.sqrt(max(mean * (1 - first / n) * (n - second) / (n - 1), 1.0)) + 40
    k = np.arange(max(low, math.floor(mean - far)), min(high, math.ceil(mean + far)) + 1)
    ratio = np.log(first - k[:-1]) + np.log(second - k[:-1]) - np.log(k[:-1] + 1) - np.log(n - first - second + k[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    share = np.exp(logs - logs.max())
    return k[np.minimum(np.searchsorted(np.cumsum(share) / share.sum(), drawn, "right"), len(k) - 1)]


def permuted(rows: DataFrame, value: str, strata: Sequence[str], key: str, seed: int, permutations: int) -> DataFrame:
    """Each stratum's values dealt anew to its rows, once for every permutation b.

    Both sides of the deal are numbered: rows by their key, values by a hash of
    (seed, b, key); equal numbers meet.
    """
    strata = list(strata)
    w = Window.partitionBy(*strata).orderBy(key)
    fixed = rows.withColumn("n", F.row_number().over(w)).drop(value)
    copies = rows.select(*strata, key, value).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    order = md5_int(F.lit(str(seed)), F.col("b").cast("string"), F.col(key).cast("string"))
    dealt = copies.withColumn("n", F.row_number().over(Window.partitionBy(*strata, "b").orderBy(order, key))).select(*strata, "b", "n", value)
    return fixed.join(dealt, [*strata, "n"])


def permuted_agreement(rows: DataFrame, x: Column, y: Column, strata: Sequence[str], seed: int, permutations: int) -> DataFrame:
    """Share of rows whose two flags agree after each permutation b of one of them within strata.

    The rows are read once, for the margins of every stratum (rows with a null flag do not
    count); each stratum then gives ``permutations`` counts.
    """
    strata = list(strata)
    margins = rows.filter(x.isNotNull() & y.isNotNull()).groupBy(*strata).agg(F.count("*").alias("n"), F.count_if(x).alias("nx"), F.count_if(y).alias("ny"))
    named = margins.select(F.concat_ws("|", *strata).alias("stratum"), md5_int(*strata).alias("u"), "n", "nx", "ny")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = seeds(seed, permutations)
        for f in frames:
            for r in f.itertuples():
                both = hypergeometric(r.n, r.nx, r.ny, mixed(base ^ np.uint64(r.u)) / DRAWS)
                yield pd.DataFrame({"b": np.arange(permutations), "n": r.n, "same": r.n - r.nx - r.ny + 2 * both})

    counts = named.mapInPandas(run, "b int, n long, same long")
    return counts.groupBy("b").agg((F.sum("same") / F.sum("n")).alias("v"))
