"""Exclusive feature bundling, as analysis: sparsity, conflicts, greedy bundles and their transform."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPARSE, MOST_BINS = 0.8, 65536


@dataclass(frozen=True)
class Bundle:
    features: tuple[int, ...]
    offsets: tuple[int, ...]
    total_bins: int


def sparsity(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, n, zeros, sparsity: one aggregate over all features."""
    made = rows.agg(F.array(*(F.struct(F.lit(k).cast("int").alias("feature"), F.count(c).alias("n"), F.count_if(F.col(c) == 0).alias("zeros")) for k, c in enumerate(features))).alias("x"))
    return made.select(F.inline("x")).withColumn("sparsity", F.when(F.col("n") > 0, F.col("zeros") / F.col("n")).otherwise(0.0))


def both_set(rows: DataFrame, features: list[str]) -> DataFrame:
    """a, b, both: rows in which both features are not zero, for the pairs that occur. A row gives the pairs of its own features, summed up where it is."""
    of = F.filter(F.array(*(F.when(F.col(c) != 0, k) for k, c in enumerate(features))), lambda k: k.isNotNull())
    held = rows.select(of.alias("_k")).where(F.size("_k") > 1)
    pairs = F.flatten(F.transform("_k", lambda a, i: F.transform(F.slice("_k", i + 2, F.size("_k")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return held.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))


def conflicts(rows: DataFrame, features: list[str]) -> DataFrame:
    """a, b, both, either, conflict for each pair: rows with both not zero over rows with any not zero."""
    d = len(features)
    set_ = F.array(*(F.struct(F.lit(k).cast("int").alias("k"), F.count_if(F.col(c) != 0).alias("n")) for k, c in enumerate(features))) if d else F.array()
    if d < 2:
        return rows.sparkSession.createDataFrame([], "a int, b int, both bigint, either bigint, conflict double")
    counts = rows.agg(set_.alias("x")).select(F.inline("x"))
    left, right = (counts.select(F.col("k").alias(x), F.col("n").alias(f"_{x}")) for x in "ab")
    # A row a feature on either side.
    every = left.join(F.broadcast(right), F.col("a") < F.col("b")).join(both_set(rows, features), ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)).cast("bigint"))
    found = every.select("a", "b", "both", (F.col("_a") + F.col("_b") - F.col("both")).alias("either"))
    return found.withColumn("conflict", F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(0.0))


def bundles(rows: DataFrame, features: list[str], max_conflict: float = 0.0, max_bin: int = 255) -> list[Bundle]:
    """Sparse features greedily together, the sparsest first, while all pairs conflict at most so much; the rest alone."""
    known = {r["feature"]: r for r in sparsity(rows, features).collect()}
    of = {k: r["sparsity"] for k, r in known.items()}
    # Only sparse features are bundled; pairs that never occur together have no conflict.
    some = [k for k in sorted(of) if of[k] > SPARSE]
    count = {k: known[k]["n"] - known[k]["zeros"] for k in some}
    rate: dict[tuple[int, int], float] = {}
    for r in both_set(rows, [features[k] for k in some]).collect() if len(some) > 1 else []:  # pairs of sparse features that occur
        a, b = some[r["a"]], some[r["b"]]
        rate[a, b] = r["both"] / (count[a] + count[b] - r["both"])
    groups: list[list[int]] = []
    for f in sorted(of, key=lambda f: (-of[f], f)):
        if of[f] > SPARSE:
            for g in groups:
                if of[g[0]] > SPARSE and (len(g) + 1) * max_bin <= MOST_BINS and all(rate.get((min(f, x), max(f, x)), 0.0) <= max_conflict for x in g):
                    g.append(f)
                    break
            else:
                groups.append([f])
        else:
            groups.append([f])
    return [Bundle(tuple(g), tuple(k * max_bin for k in range(len(g))), len(g) * max_bin) for g in groups]


def transform(bundle: Bundle, features: list[str], bin_of) -> Column:
    """The bundle's value: offset + bin of its first feature that is not zero, else 0. bin_of(feature number) gives a bin."""
    out = F.lit(0)
    for f, offset in reversed(list(zip(bundle.features, bundle.offsets, strict=True))):
        out = F.when(F.col(features[f]) != 0, F.lit(offset) + bin_of(f)).otherwise(out)
    return out
