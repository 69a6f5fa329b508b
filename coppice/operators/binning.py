"""Bins of features and their histograms.

A bin holds (lo, hi]; a value equal to an edge lies in the bin that ends there, as routing value <= threshold demands.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import running

LEAST_BINS, MOST_BINS = 8, 128
#: Edges of a feature that are still written as conditions.
NESTED = 64


def long_rows(rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """A row for each row and feature: keep, feature (its number), value. Only the named columns are read."""
    pairs = F.array(*(F.struct(F.lit(k).cast("int").alias("feature"), F.col(c).cast("double").alias("value")) for k, c in enumerate(features)))
    return rows.select(*keep, F.inline(pairs))


def bounds(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, n, lo, hi; one aggregate over all features. Null and NaN are no values."""
    known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features]
    aggs = [F.struct(F.lit(k).cast("int").alias("feature"), F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")) for k, x in enumerate(known)]
    return rows.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


def adaptive_bins(n: int, rule: str, value_range: float = 0.0, iqr: float = 0.0) -> int:
    """Number of equal-width bins by a rule, from 8 to 128."""
    if n < 1:
        return LEAST_BINS
    if rule == "rice":
        k = math.ceil(2 * n ** (1 / 3))
    elif rule == "sqrt":
        k = math.ceil(math.sqrt(n))
    elif rule == "freedman_diaconis" and iqr > 0:
        k = math.ceil(value_range / (2 * iqr / n ** (1 / 3)))
    else:
        k = math.ceil(math.log2(n)) + 1
    return min(MOST_BINS, max(LEAST_BINS, k))


def rank_values(rows: DataFrame, features: list[str], ranks: dict[str, float] | None = None, at=None) -> DataFrame:
    """(feature, name, value) of the sorted values of given ranks; at(n) -> {name: rank column} from 0."""
    counts = long_rows(rows, features, []).where("value is not null and not isnan(value)").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    cum = running(counts, ["feature"], "value", ["c"]).withColumnsRenamed({"c_c": "upto", "t_c": "n"})
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("bigint").alias("rank")) for k, v in at(F.col("n")).items())))
    return cum.select("*", wanted.alias("q")).where("upto > q.rank and upto - c <= q.rank").select("feature", F.col("q.name").alias("name"), "value")


def equal_width(rows: DataFrame, features: list[str], bins: int | dict[int, int]) -> dict[int, list[float]]:
    """Upper edges of each feature; a constant feature has one bin."""
    out = {}
    for r in bounds(rows, features).collect():
        k = bins[r["feature"]] if isinstance(bins, dict) else bins
        lo, hi = r["lo"], r["hi"]
        out[r["feature"]] = [] if lo is None else [hi] if hi - lo < 1e-12 else [lo + (hi - lo) / k * (b + 1) for b in range(k - 1)] + [hi]
    return out


def equal_width_adaptive(rows: DataFrame, features: list[str], rule: str) -> dict[int, list[float]]:
    iqr = {}
    if rule == "freedman_diaconis":
        for r in rank_values(rows, features, at=lambda n: {"q1": F.floor(n / 4), "q3": F.floor(3 * n / 4)}).collect():
            iqr.setdefault(r["feature"], {})[r["name"]] = r["value"]
    counts = {r["feature"]: adaptive_bins(r["n"], rule, (r["hi"] or 0) - (r["lo"] or 0), (q := iqr.get(r["feature"], {})).get("q3", 0) - q.get("q1", 0)) for r in bounds(rows, features).collect()}
    return equal_width(rows, features, counts)


def equal_frequency(rows: DataFrame, features: list[str], bins: int) -> dict[int, list[float]]:
    """Upper edges: the last value of each of the bins that ntile would make; equal edges are one. From counts of distinct values."""

    def at(n: Column) -> dict[str, Column]:
        size, more = F.floor(n / bins), n % bins
        return {str(b): F.greatest(b * size + F.least(F.lit(b), more) - 1, F.lit(0)) for b in range(1, bins + 1)}

    out: dict[int, list[float]] = {k: [] for k in range(len(features))}
    for r in rank_values(rows, features, at=at).collect():  # bins values a feature
        out[r["feature"]].append(r["value"])
    return {k: sorted(set(v)) for k, v in out.items()}


def literal(numbers: list[float]) -> str:
    """SQL of an array of doubles: one literal, however many they are."""
    each = ", ".join(f"{float(x)!r}D" if math.isfinite(x) else f"double('{x}')" for x in numbers)
    return f"array({each})" if numbers else "cast(array() as array<double>)"


def bin_of(value: Column, edges: list[float]) -> Column:
    """Number of the bin whose upper edge is the first at or above the value; the last one without a value or beyond all.

    A binary search in nested conditions, which would be too much code for many edges: these are searched in batches.
    """
    n = len(edges)
    if n < 2:
        return F.lit(0)
    if n > NESTED:
        @F.pandas_udf("int")
        def searched(x: pd.Series) -> pd.Series:
            at = np.minimum(np.searchsorted(edges, x.to_numpy(float)), n - 1)
            return pd.Series(np.where(x.isna(), n - 1, at)).astype("int32")

        return searched(value)

    def search(a: int, z: int) -> Column:
        if a == z:
            return F.lit(a)
        m = (a + z) // 2
        return F.when(value <= edges[m], search(a, m)).otherwise(search(m + 1, z))

    return search(0, n - 1).cast("int")


def binned(rows: DataFrame, features: list[str], edges: dict[int, list[float]], keep: list[str], gaps: bool = False) -> DataFrame:
    """keep and a small integer column b0, b1, ... for each feature: made once, used at every level. Rows without a value lie in the last bin, or (gaps) in none."""
    values = [F.col(c).cast("double") for c in features]
    bins = [bin_of(x, edges[k]) for k, x in enumerate(values)]  # neither null nor NaN is at or below an edge
    return rows.select(*keep, *((F.when(x.isNotNull() & ~F.isnan(x), b) if gaps else b).alias(f"b{k}") for k, (x, b) in enumerate(zip(values, bins, strict=True))))


def histogram(rows: DataFrame, features: list[str], edges: dict[int, list[float]], label: str, node: str | None = None) -> DataFrame:
    """[node,] feature, bin, lo, hi, cnt, s1, s2 and the running sums c_cnt, c_s1, c_s2. Empty bins are left out."""
    keys = [node] if node else []
    pairs = F.array(*(F.struct(F.lit(k).cast("int").alias("feature"), bin_of(F.col(c).cast("double"), edges[k]).alias("bin")) for k, c in enumerate(features)))
    y = F.col("_y")
    sums = rows.select(*keys, F.col(label).cast("double").alias("_y"), F.inline(pairs)).groupBy(*keys, "feature", "bin").agg(F.count(y).alias("cnt"), F.sum(y).alias("s1"), F.sum(y * y).alias("s2"))
    return with_running(sums, keys)


def with_running(sums: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.withColumns({f"c_{c}": F.sum(c).over(w) for c in ("cnt", "s1", "s2")})


def subtract(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Histogram of the sibling: parent less child, without another pass over the rows."""
    c = child.select("feature", "bin", *(F.col(x).alias(f"_{x}") for x in ("cnt", "s1", "s2")))
    left = parent.select("feature", "bin", "cnt", "s1", "s2").join(c, ["feature", "bin"], "left")
    diff = left.select("feature", "bin", *((F.col(x) - F.coalesce(F.col(f"_{x}"), F.lit(0))).alias(x) for x in ("cnt", "s1", "s2"))).where("cnt > 0")
    return with_running(diff, [])


def changed(histogram_: DataFrame, other: DataFrame, sign: int) -> DataFrame:
    """A histogram with the rows of another one added (1) or removed (-1); running sums are made anew."""
    more = other.select("feature", "bin", *((sign * F.col(c)).alias(c) for c in ("cnt", "s1", "s2")))
    both = histogram_.select("feature", "bin", "cnt", "s1", "s2").unionByName(more).groupBy("feature", "bin").agg(*(F.sum(c).alias(c) for c in ("cnt", "s1", "s2")))
    return with_running(both.where("cnt > 0"), [])


def range_stats(histogram_: DataFrame, feature: int, first: int, last: int) -> DataFrame:
    """One row: cnt, s1, s2, mean and mse of the bins first..last-1 of a feature, from differences of its running sums."""
    upto = lambda k, c: F.coalesce(F.max_by(f"c_{c}", F.when(F.col("bin") < k, F.col("bin"))), F.lit(0))
    got = histogram_.where(F.col("feature") == feature).agg(*((upto(last, c) - upto(first, c)).alias(c) for c in ("cnt", "s1", "s2")))
    mean = F.when(F.col("cnt") > 0, F.col("s1") / F.col("cnt")).otherwise(0.0)
    return got.withColumn("mean", mean).withColumn("mse", F.when(F.col("cnt") > 0, F.greatest(F.lit(0.0), F.col("s2") / F.col("cnt") - F.col("mean") * F.col("mean"))).otherwise(0.0))


def adaptive_frequency_edges(rows: DataFrame, features: list[str], most: int = 64, least: int = 5) -> dict[int, list[float]]:
    """Upper edges of bins of equal frequency whose number follows the spread of each feature: few where the coefficient of variation is small."""
    stats = long_rows(rows, features, []).where("value is not null and not isnan(value)").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("d")).collect()  # a row a feature
    out: dict[int, list[float]] = {k: [] for k in range(len(features))}
    for r in stats:
        root = math.floor(math.sqrt(r["n"]))
        bins = min(max(root // 2, 4), 16) if r["d"] / (abs(r["m"]) + 1e-12) < 0.1 else min(max(root, 8), most)
        out[r["feature"]] = equal_frequency(rows, [features[r["feature"]]], max(1, min(bins, r["n"] // least)))[0]
    return out


def report(histogram_: DataFrame) -> DataFrame:
    """feature, bins, rows and bytes (five numbers of eight bytes a bin) that a histogram holds."""
    return histogram_.groupBy("feature").agg(F.count(F.lit(1)).alias("bins"), F.sum("cnt").alias("rows"), (F.count(F.lit(1)) * 40).alias("bytes"))


class HistogramCache:
    """Histograms by name, computed once and held in memory until they are cleared; the oldest goes when there are too many."""

    def __init__(self, most: int = 32):
        self.most, self.held, self.hits, self.misses = most, {}, 0, 0

    def get(self, name: str, make) -> DataFrame:
        if name in self.held:
            self.hits += 1
            self.held[name] = self.held.pop(name)
            return self.held[name]
        self.misses += 1
        if len(self.held) >= self.most:
            self.held.pop(next(iter(self.held))).unpersist()
        self.held[name] = make().persist()
        return self.held[name]

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held = {}
