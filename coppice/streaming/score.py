"""Scoring and watching a stream with a trained ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import Ensemble


def score_stream(model: Ensemble, rows: DataFrame, name: str = "prediction") -> DataFrame:
    """A stream of rows with predictions; no state."""
    return model.score(rows, name)


def windowed_error(scored: DataFrame, time: str, label: str = "label", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, n, mse and mae of each window of event time; rows later than the watermark are left out."""
    r = F.col(label) - F.col("prediction")
    return scored.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(r).alias("n"), F.avg(r * r).alias("mse"), F.avg(F.abs(r)).alias("mae"))
