"""First-order boosting on any loss, with line search, early stopping and dropout of trees (DART)."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.binning import binned
from ..operators.sampling import subsample
from ..operators.splits import Search, additive, ranked_values, with_edges
from . import grow, local_boost, registry
from .model import Ensemble, score_trees
from .store import Rolling, scope

#: Rounds between cuts of the lineage of the prediction column.
CUT_EVERY = 5
PREDICTION, RESIDUAL, PARTS = "_pred", "_resid", "_parts"


@dataclass(frozen=True)
class BoostingConfig:
    loss: str = "squared"
    rounds: int = 30
    rate: float = 0.1
    max_depth: int = 4
    min_leaf: int = 1
    finder: str = "exhaustive"
    criterion: str = "mse"
    subsample: float = 1.0
    line_search: bool = False
    patience: int = 0
    tolerance: float = 1e-7
    seed: int = 42
    dart: bool = False
    drop_rate: float = 0.1
    #: none, mild, original or experimental; uniform or weighted drop.
    normalise: str = "none"
    adaptive_drop: bool = False
    skip_drop_for_prediction: bool = True
    #: Small tables and nodes grow in one task; the trees are the same.
    local: bool = True


def mean_loss(rows: DataFrame, loss: registry.exprs.Loss, label: str, prediction: str) -> float:
    return rows.agg(F.avg(loss.loss(F.col(label), F.col(prediction)))).first()[0] or 0.0


def should_stop(losses: list[float], patience: int, tolerance: float) -> bool:
    """The last loss is no better than the best of the patience losses before it."""
    return 0 < patience < len(losses) and losses[-1] >= min(losses[-1 - patience : -1]) - tolerance


def line_search(rows: DataFrame, loss: registry.exprs.Loss, label: str, step: str, rounds: int = 10, tolerance: float = 1e-3) -> float:
    """The rate in [0, 1] of least loss by golden section; both probes of a round are one aggregate."""
    ratio = (math.sqrt(5) - 1) / 2
    low, high = 0.0, 1.0
    for _ in range(rounds):
        if high - low < tolerance:
            break
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        at = [F.avg(loss.loss(F.col(label), F.col(PREDICTION) + x * F.col(step))) for x in (a, b)]
        la, lb = rows.agg(at[0].alias("a"), at[1].alias("b")).first()
        low, high = (low, b) if la < lb else (a, high)
    return (low + high) / 2


def loss_grid(rows: DataFrame, loss: registry.exprs.Loss, label: str, prediction: str, step: str, rates: list[float]) -> DataFrame:
    """rate, loss for each rate: one aggregate."""
    cells = [F.struct(F.lit(r).alias("rate"), F.avg(loss.loss(F.col(label), F.col(prediction) + r * F.col(step))).alias("loss")) for r in rates]
    return rows.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def dropped(model: Ensemble, config: BoostingConfig, rng: random.Random) -> list[int]:
    """Trees left out of a round; one at least, if the rate is in (0, 1)."""
    n = len(model.trees)
    if not n or not 0 < config.drop_rate < 1:
        return []
    if config.adaptive_drop:
        size = [abs(f) + 1e-12 for f in model.factors()]
        return sorted(set(rng.choices(range(n), size, k=math.ceil(n * config.drop_rate))))
    out = [k for k in range(n) if rng.random() < config.drop_rate]
    return out or [rng.randrange(n)]


def reweight(model: Ensemble, out: list[int], how: str, rate: float) -> None:
    """Weights of the tree just added (the last) and of those dropped. The factors are fixed values of the known variants."""
    k, t = len(out), len(model.trees)
    if not k or how == "none":
        return
    if how == "mild":
        model.weights[-1] = rate * min(1 + 0.05 * k, 1.2)
    elif how == "original":
        model.weights[-1] = rate * (k + 1)
        for i in out:
            model.weights[i] *= (k + 1) / k
    elif how == "experimental":
        model.weights[-1] = rate * (1 + 0.5 * k / t)
        model.rates[-1] *= max(0.95, 1 - 0.1 * k / t)
    else:
        raise ValueError(how)


def train(rows: DataFrame, features: list[str], label: str, row_id: str, config: BoostingConfig = BoostingConfig(), validation: DataFrame | None = None) -> Ensemble:
    """Stops early on the validation loss, or on the training loss where there is none. Rows without a finite label take no part."""
    loss, rng = registry.loss(config.loss), random.Random(config.seed)
    rows = grow.labelled(rows, label)
    n, base = rows.agg(F.count(F.lit(1)), F.avg(label)).first()
    base = base or 0.0
    plain = config.finder in ("exhaustive", "exact") and config.criterion == "mse" and config.subsample >= 1 and not (config.dart or config.line_search) and validation is None
    if plain and config.local and n <= local_boost.LOCAL_TRAIN_ROWS:
        return local_boost.train(rows, features, label, row_id, config.rounds, config.rate, grow.Growth(config.max_depth, config.min_leaf), local_boost.first_order(config.loss), base, lambda losses: should_stop(losses, config.patience, config.tolerance))
    model = Ensemble(features, base=base)
    growth = grow.Growth(config.max_depth, config.min_leaf, finish_locally=config.local)
    source = rows.select(row_id, label, *(c for c in features if c not in (row_id, label))).persist()
    search = ranked_values(source, with_edges(source, Search(features=features, label=RESIDUAL, finder=config.finder, criterion=config.criterion, seed=config.seed)))
    first = source
    if search.edges and additive(search):
        first, search = binned(source, features, search.edges, source.columns, search.ranked), replace(search, binned=True)
    # Each tree's leaf value of a row is held beside it where trees are left out, so that leaving out is arithmetic.
    parts = F.array().cast("array<double>") if config.dart else None
    table = Rolling(first.withColumn(PREDICTION, F.lit(base)) if parts is None else first.withColumns({PREDICTION: F.lit(base), PARTS: parts}))
    losses: list[float] = []
    for i in range(config.rounds):
        out = dropped(model, config, rng) if config.dart else []
        seen = table.now
        if out:
            factors = model.factors()
            seen = seen.withColumn(PREDICTION, weighted(base, [0.0 if k in out else float(x) for k, x in enumerate(factors)]))
        with scope():
            train_loss = mean_loss(seen, loss, label, PREDICTION)
            table.settled()
            resid = seen.withColumn(RESIDUAL, loss.gradient(F.col(label), F.col(PREDICTION)))
            tree = grow.level_wise(subsample(resid, row_id, config.subsample, config.seed + i), search, growth)
            value = score_trees([tree], [1.0], features)
            rate = line_search(seen.withColumn("_step", value), loss, label, "_step") if config.line_search else config.rate
        model.add(tree, 1.0, rate)
        reweight(model, out, config.normalise, rate)
        cut = (i + 1) % CUT_EVERY == 0
        if config.dart:
            grown = table.now.withColumn(PARTS, F.array_append(PARTS, value))
            table.replace(grown.withColumn(PREDICTION, weighted(base, [float(x) for x in model.factors()])), cut)
        else:
            table.replace(table.now.withColumn(PREDICTION, F.col(PREDICTION) + float(model.factors()[-1]) * value), cut)
        model.history.append({"iter": i, "train_loss": train_loss, "lr": rate, "n_dropped": len(out)})
        losses.append(mean_loss(model.score(validation, PREDICTION), loss, label, PREDICTION) if validation is not None else train_loss)
        if should_stop(losses, config.patience, config.tolerance):
            break
    table.close()
    source.unpersist()
    return model


def weighted(base: float, factors: list[float]) -> Column:
    """The prediction from the leaf values of all trees, by their factors."""
    if not factors:
        return F.lit(base)
    each = F.zip_with(PARTS, F.array(*map(F.lit, factors)), lambda v, f: v * f)
    return F.aggregate(each, F.lit(base), lambda a, v: a + v)


def predict(model: Ensemble, rows: DataFrame, config: BoostingConfig) -> DataFrame:
    """All trees, unless a DART model is asked not to skip dropping: then a seeded draw is left out, as in training."""
    if config.dart and not config.skip_drop_for_prediction:
        out = set(dropped(model, config, random.Random(config.seed)))
        return model.score(rows, trees=[k for k in range(len(model.trees)) if k not in out])
    return model.score(rows)


def evaluate(model: Ensemble, rows: DataFrame, label: str, config: BoostingConfig) -> DataFrame:
    """One row: n, loss (of the configured kind), mse and mae."""
    y, p = F.col(label), F.col("prediction")
    return predict(model, rows, config).agg(F.count(y - p).alias("n"), F.avg(registry.loss(config.loss).loss(y, p)).alias("loss"), F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"))
