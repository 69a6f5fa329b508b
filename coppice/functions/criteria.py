"""Node metrics: the impurity of each group of rows. A group without labels has metric 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import log_cosh

HUBER_DELTA, TINY = 1.0, 1e-12


def _about_centre(r: Column, mean: Column, y: Column, name: str) -> Column:
    """The average whose centre has been joined to each row."""
    if name == "mae":
        return F.avg(F.abs(r))
    if name == "huber":
        return F.avg(F.when(F.abs(r) <= HUBER_DELTA, 0.5 * r * r).otherwise(HUBER_DELTA * (F.abs(r) - 0.5 * HUBER_DELTA)))
    if name == "logcosh":
        return F.avg(log_cosh(r))
    if name == "poisson":
        m = F.greatest(mean, F.lit(TINY))
        return F.avg(m - F.greatest(y, F.lit(TINY)) * F.ln(m))
    raise ValueError(name)


def quantile_by_rank(rows: DataFrame, keys: list[str], label: str, tau: float, middle: bool = False) -> DataFrame:
    """keys and centre, the lower quantile (middle: the mean of lower and upper one), from counts of distinct labels: no group is gathered in one place."""
    from ..plans.ranking import running

    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counts, keys, label, ["_c"])
    last = F.col("t__c") - 1
    at = lambda rank: (F.col("c__c") > rank) & (F.col("c__c") - F.col("_c") <= rank)
    if not middle:
        return ranked.where(at(F.floor(tau * last))).select(*keys, F.col(label).alias("centre"))
    ends = ranked.where(at(F.floor(tau * last)) | at(F.ceil(tau * last)))
    return ends.groupBy(*keys).agg(((F.min(label) + F.max(label)) / 2).alias("centre"))


def node_metric(rows: DataFrame, keys: list[str], label: str, criterion: str = "mse") -> DataFrame:
    """keys, samples, node_mean and metric. criterion: mse, mae, huber, quantile[:tau], logcosh, poisson; others are mse."""
    name, _, param = criterion.partition(":")
    y = F.col(label)
    if name not in ("mae", "huber", "quantile", "logcosh", "poisson"):
        return rows.groupBy(*keys).agg(F.count(y).alias("samples"), F.avg(y).alias("node_mean"), F.coalesce(F.var_pop(y), F.lit(0.0)).alias("metric"))
    means = rows.groupBy(*keys).agg(F.avg(y).alias("node_mean"))
    if name == "mae":
        means = means.join(quantile_by_rank(rows.where(y.isNotNull()), keys, label, 0.5, True), keys)
    if name == "quantile":
        tau = float(param or 0.5)
        centres = means.join(quantile_by_rank(rows.where(y.isNotNull()), keys, label, tau), keys)
        joined = rows.join(centres, keys)
        r = y - F.col("centre")
        metric = F.avg(r * F.when(r < 0, tau - 1).otherwise(tau))
    else:
        joined = rows.join(means, keys)
        r = y - F.col("centre" if name == "mae" else "node_mean")
        metric = _about_centre(r, F.col("node_mean"), y, name)
    return joined.groupBy(*keys).agg(F.count(y).alias("samples"), F.avg(y).alias("node_mean"), F.coalesce(metric, F.lit(0.0)).alias("metric"))


def evaluate(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: n, mse, mae."""
    r = F.col(label) - F.col(prediction)
    return scored.agg(F.count(r).alias("n"), F.avg(r * r).alias("mse"), F.avg(F.abs(r)).alias("mae"))
