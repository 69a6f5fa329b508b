"""Second-order boosting: gradients and hessians, regularised gains, row and feature sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.binning import binned
from ..operators.sampling import columns_of, subsample
from ..operators.splits import Search, ranked_values, with_edges
from . import grow, local_boost, registry
from .boosting import CUT_EVERY, PREDICTION, mean_loss, should_stop
from .model import Ensemble, score_trees
from .store import Rolling, scope


@dataclass(frozen=True)
class NewtonConfig:
    objective: str = "reg:squarederror"
    rounds: int = 100
    eta: float = 0.3
    max_depth: int = 6
    min_child_weight: float = 1.0
    lam: float = 1.0
    gamma: float = 0.0
    alpha: float = 0.0
    subsample: float = 1.0
    colsample: float = 1.0
    #: Searches equal-width bins instead of all values.
    approximate: bool = False
    max_bins: int = 256
    patience: int = 0
    tolerance: float = 1e-7
    seed: int = 42
    #: Small tables and nodes grow in one task; the trees are the same.
    local: bool = True

    def __post_init__(self):
        for name, ok in (("eta", 0 < self.eta <= 1), ("subsample", 0 < self.subsample <= 1), ("colsample", 0 < self.colsample <= 1), ("rounds", self.rounds > 0), ("max_depth", self.max_depth > 0), ("lam", self.lam >= 0), ("gamma", self.gamma >= 0)):
            if not ok:
                raise ValueError(f"{name} is out of range")
        registry.objective(self.objective)


def train(rows: DataFrame, features: list[str], label: str, row_id: str, config: NewtonConfig = NewtonConfig(), validation: DataFrame | None = None) -> Ensemble:
    """Stops early on the validation loss, or on the training loss where there is none. Rows without a finite label take no part."""
    loss = registry.objective(config.objective)
    rows = grow.labelled(rows, label)
    n, base = rows.agg(F.count(F.lit(1)), F.avg(label)).first()
    base = base or 0.0
    plain = not config.approximate and config.subsample >= 1 and config.colsample >= 1 and not config.alpha and validation is None
    if plain and config.local and n <= local_boost.LOCAL_TRAIN_ROWS:
        return local_boost.train(rows, features, label, row_id, config.rounds, config.eta, grow.Growth(config.max_depth, 1), local_boost.second_order(config.objective), base, lambda losses: should_stop(losses, config.patience, config.tolerance), (config.lam, config.gamma, config.min_child_weight))
    model = Ensemble(features, base=base)
    source = rows.select(row_id, label, *(c for c in features if c not in (row_id, label))).persist()
    finder = f"histogram_ew:{config.max_bins}" if config.approximate else "exhaustive"
    search = ranked_values(source, with_edges(source, Search(features=features, finder=finder, newton=("_g", "_h"))))
    first = binned(source, features, search.edges, source.columns, search.ranked) if search.edges else source
    table, losses = Rolling(first.withColumn(PREDICTION, F.lit(base))), []
    for i in range(config.rounds):
        train_loss = mean_loss(table.now, loss, label, PREDICTION)
        table.settled()
        y, p = F.col(label), F.col(PREDICTION)
        chosen = columns_of(features, config.colsample, config.seed + i)
        s = Search(features=[features[k] for k in chosen], label=label, newton=("_g", "_h"), lam=config.lam, gamma=config.gamma, min_child_weight=config.min_child_weight, finder=finder, edges={j: search.edges[k] for j, k in enumerate(chosen)} if search.edges else {}, binned=bool(search.edges), ranked=search.ranked)
        with scope():
            with_g = subsample(table.now.withColumns({"_g": loss.gradient(y, p), "_h": loss.hessian(y, p)}), row_id, config.subsample, config.seed + i)
            if search.edges:
                with_g = with_g.select("_g", "_h", *(F.col(f"b{k}").alias(f"b{j}") for j, k in enumerate(chosen)))
            tree = grow.level_wise(with_g, s, grow.Growth(config.max_depth, 1, finish_locally=config.local))
        for n in tree.values():
            n.feature = chosen[n.feature] if not n.is_leaf else -1
            if config.alpha and n.is_leaf:
                h = n.metric + config.lam
                g = -n.prediction * h
                n.prediction = -((g > 0) - (g < 0)) * max(abs(g) - config.alpha, 0.0) / h if h > 0 else 0.0
        model.add(tree, config.eta)
        table.replace(table.now.withColumn(PREDICTION, F.col(PREDICTION) + score_trees([tree], [config.eta], features)), (i + 1) % CUT_EVERY == 0)
        model.history.append({"iter": i, "train_loss": train_loss, "lr": config.eta, "n_dropped": 0})
        losses.append(mean_loss(model.score(validation, PREDICTION), loss, label, PREDICTION) if validation is not None else train_loss)
        if should_stop(losses, config.patience, config.tolerance):
            break
    table.close()
    source.unpersist()
    return model


def probability(scored: DataFrame, margin: str = "prediction") -> DataFrame:
    """Adds proba, the sigmoid of the margin."""
    return scored.withColumn("proba", registry.exprs.sigmoid(F.col(margin)))
