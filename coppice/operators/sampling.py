"""Row and feature sampling by arithmetic hashes of ids: the same rows at every run and in every engine."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import numbered
from ..plans.store import stored
from .splits import uniform

#: Column of the numbered rows of a bootstrap.
DRAWN = "_drawn"
#: Cells of a count, accuracy of the sketch that goes before it, and rows of a cell that may come to the driver.
BINS, SKETCH, FEW_VALUES = 1024, 10_000, 10_000


def bootstrap(rows: DataFrame, row_id: str, trees: int, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """tree_id, rn (from 1, in order of row_id) and w, how often it was drawn: floor(N * ratio) draws with replacement a tree."""
    n = rows.count()
    m = int(n * ratio)
    spark = rows.sparkSession
    draws = spark.range(trees * m).select(F.floor(F.col("id") / max(m, 1)).cast("int").alias("tree_id"), (F.floor(uniform(F.lit(seed), F.col("id")) * n) + 1).cast("bigint").alias("rn"))
    # Dealt out by rn alone: what goes on by row, or joins rows, needs no other shuffle.
    return draws.repartition("rn").groupBy("tree_id", "rn").agg(F.count(F.lit(1)).alias("w"))


def with_bootstrap(rows: DataFrame, row_id: str, trees: int, ratio: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(in the bag: rows with tree_id and w; numbered rows with rn and drawn, the trees that drew them and how often). Draws are made once, for both."""
    ranked = numbered(rows, [F.col(row_id)])
    drawn = bootstrap(rows, row_id, trees, ratio, seed).groupBy("rn").agg(F.collect_list(F.struct("tree_id", "w")).alias(DRAWN))
    ranked = stored(ranked.join(drawn, "rn", "left"))
    return ranked.select("*", F.inline(DRAWN)).drop(DRAWN), ranked


def kth(rows: DataFrame, value: Column, k: int, few: int = FEW_VALUES, n: int | None = None, uniform_values: bool = False) -> tuple[float, int, int]:
    """(the k-th smallest value, from 1; how many lie below it; how many equal it): selection by counts, without a sort.

    A sketch brackets the rank (values known to be uniform in [0, 1) are bracketed by their deviation), then counts of equal
    ranges narrow the bracket until it holds few different values. Each step is one aggregate of a bounded number of rows.
    """
    x = rows.select(value.alias("x")).where("x is not null")
    n = x.count() if n is None else n
    k = min(k, n)
    if uniform_values:
        room = 6 * math.sqrt(k * (1 - k / n) + 1) / n
        low, high, inside = max(0.0, k / n - room), min(1.0, k / n + room), math.ceil(2 * room * n)
    else:
        room = 2.0 / SKETCH
        low, high = x.agg(F.percentile_approx("x", [max(0.0, k / n - room), min(1.0, k / n + room)], SKETCH)).first()[0]
        inside = math.ceil(2 * room * n)
    while True:
        at = F.floor((F.col("x") - low) / (high - low) * BINS) if high > low else F.lit(0)
        cell = F.col("x") if inside <= few else F.least(at, F.lit(BINS - 1))
        side = F.when(F.col("x") < low, -1).when(F.col("x") <= high, 0).otherwise(1)
        found = x.select(side.alias("side"), F.when(side == 0, cell).alias("cell"), "x").groupBy("side", "cell").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        found.sort(key=lambda r: (r["side"], r["a"]))
        below = 0
        for r in found:
            if below + r["c"] >= k:
                break
            below += r["c"]
        low, high, inside = r["a"], r["b"], r["c"]
        if low == high:
            return low, below, r["c"]


def first_rows(rows: DataFrame, value: Column, tie: str, k: int, n: int | None = None, uniform_values: bool = False) -> Column:
    """The condition that holds for the k rows that come first by value, then by tie (an integer, unique); none for k = 0."""
    if k <= 0:
        return F.lit(False)
    cut, below, equal = kth(rows, value, k, n=n, uniform_values=uniform_values)
    if below + equal == k:
        return value <= cut
    last, *_ = kth(rows.where(value == cut), F.col(tie), k - below, n=equal)
    return (value < cut) | (value == cut) & (F.col(tie) <= last)


def subsample(rows: DataFrame, row_id: str, share: float, seed: int = 42) -> DataFrame:
    """floor(N * share) rows without replacement: the first in order of a hash of row_id."""
    if share >= 1:
        return rows
    n = rows.count()
    return rows.where(first_rows(rows, uniform(F.lit(seed), F.col(row_id)), row_id, int(n * share), n, True))


def columns_of(features: list[str], share: float, seed: int) -> list[int]:
    """max(1, floor(D * share)) feature numbers: those of the smallest hashes, as splits.uniform has them."""
    d = len(features)
    draw = lambda k: int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:13], 16)
    return sorted(sorted(range(d), key=draw)[: max(1, int(d * share))]) if share < 1 else list(range(d))


def goss_sizes(n: int, top: float, other: float) -> tuple[int, int]:
    k = int(n * top)
    return k, int((n - k) * other)


def valid_rates(top: float, other: float) -> bool:
    return 0 < top < 1 and 0 < other < 1 and top + other <= 1


def goss(rows: DataFrame, gradient: str, row_id: str, top: float = 0.2, other: float = 0.1, seed: int = 42, normalise: bool = False, n: int | None = None) -> DataFrame:
    """The rows of largest gradients with w 1 and a sample of the rest with w (1 - top) / other. Rows without a gradient are left out; n: how many have one. Invalid rates: all rows, w 1."""
    if not valid_rates(top, other):
        return rows.withColumn("w", F.lit(1.0))
    known = rows.where(F.col(gradient).isNotNull() & ~F.isnan(gradient))
    n = known.count() if n is None else n
    k, m = goss_sizes(n, top, other)
    large = first_rows(known, -F.abs(gradient), row_id, k, n)
    drawn = first_rows(known.where(~large), uniform(F.lit(seed), F.col(row_id)), row_id, m, n - k, True)
    out = known.where(large | drawn).withColumn("w", F.when(large, 1.0).otherwise((1 - top) / other))
    total = k + m * (1 - top) / other
    return out.withColumn("w", F.col("w") * F.lit(n / total)) if normalise and total > 0 else out


def goss_stats(sampled: DataFrame, gradient: str, n: int) -> DataFrame:
    """One row: n_sampled, ratio, sum_w, max_abs_g, min_abs_g."""
    g = F.abs(gradient)
    return sampled.agg(F.count(F.lit(1)).alias("n_sampled"), F.sum("w").alias("sum_w"), F.max(g).alias("max_abs_g"), F.min(g).alias("min_abs_g")).withColumn("ratio", F.col("n_sampled") / float(max(n, 1)))


def adaptive_rates(cv: float, top: float, other: float) -> tuple[float, float]:
    """Rates by the coefficient of variation of the gradients' size. Bounds and factors are fixed values of the known method."""
    if cv > 2:
        return min(0.5, 1.5 * top), max(0.05, 0.8 * other)
    if cv < 0.5:
        return max(0.1, 0.8 * top), min(0.3, 1.2 * other)
    return top, other


def gradient_cv(rows: DataFrame, gradient: str) -> DataFrame:
    g = F.abs(gradient)
    return rows.agg((F.stddev_pop(g) / (F.avg(g) + 1e-12)).alias("cv"))
