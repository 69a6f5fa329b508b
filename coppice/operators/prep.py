"""Preprocessing: outlier filters, equal-frequency bins, sequential splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import ntile_of, numbered

TINY = 1e-12


def within(x: Column, mean: Column, std: Column, z: float) -> Column:
    return F.abs((x - mean) / (std + TINY)) <= z


def zscore_filter(df: DataFrame, column: str, z: float = 3.0) -> DataFrame:
    """Rows within z population standard deviations of the mean. The statistics are one row, sent to every task."""
    stats = df.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_std"))
    return df.crossJoin(F.broadcast(stats)).where(within(F.col(column), F.col("_mean"), F.col("_std"), z)).select(*df.columns)


def equal_frequency_bins(df: DataFrame, column: str, k: int, row_id: str, name: str = "bin") -> DataFrame:
    """df with a bin from 0 to k-1 by rank; ties go by row_id, the first n mod k bins have one row more."""
    ranked = numbered(df, [F.col(column), F.col(row_id)], "_rn")
    return ranked.withColumn(name, ntile_of(F.col("_rn"), df.count(), k) - 1).drop("_rn")


def binwise_filter(df: DataFrame, x: str, y: str, k: int, z: float, target: str, row_id: str) -> DataFrame:
    """Rows of each bin (by x or by y) whose target is within z of the bin's mean. A row in two bins can be there twice."""
    both = equal_frequency_bins(equal_frequency_bins(df, x, k, row_id, "_bx"), y, k, row_id, "_by")
    rows = both.withColumn("bin", F.explode(F.array_distinct(F.array("_bx", "_by"))))
    stats = rows.groupBy("bin").agg(F.avg(target).alias("_mean"), F.stddev_pop(target).alias("_std"))
    kept = rows.join(F.broadcast(stats), "bin").where(within(F.col(target), F.col("_mean"), F.col("_std"), z))  # k rows
    return kept.select(*df.columns, "bin")


def sequential_split(df: DataFrame, row_id: str, shares: tuple[float, ...] = (0.8,)) -> DataFrame:
    """df with part: 0 for the first floor(share * N) rows in order of row_id, 1 for the next share, and so on."""
    ranked, n = numbered(df, [F.col(row_id)], "_rn"), df.count()
    part, upto = F.lit(len(shares)), 0
    cuts = []
    for s in shares:
        upto += int(s * n)
        cuts.append(upto)
    for k in reversed(range(len(cuts))):
        part = F.when(F.col("_rn") <= cuts[k], k).otherwise(part)
    return ranked.withColumn("part", part.cast("int")).drop("_rn")


def train_test(df: DataFrame, row_id: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    marked = sequential_split(df, row_id, (share,))
    return marked.where("part = 0").drop("part"), marked.where("part = 1").drop("part")


def train_validation_test(df: DataFrame, row_id: str, validation: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """0.7 train, then validation, then the rest; without validation 0.8 train and the rest."""
    marked = sequential_split(df, row_id, (0.7, validation) if validation > 0 else (0.8, 0.0))
    return tuple(marked.where(F.col("part") == k).drop("part") for k in range(3))


def validation_tail(train: DataFrame, row_id: str, share: float) -> tuple[DataFrame, DataFrame]:
    """(head, tail): the last floor(share * N) training rows are the tail."""
    n = train.count()
    ranked = numbered(train, [F.col(row_id)], "_rn")
    cut = n - int(share * n)
    return ranked.where(F.col("_rn") <= cut).drop("_rn"), ranked.where(F.col("_rn") > cut).drop("_rn")
