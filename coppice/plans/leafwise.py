"""Leaf-wise boosting: best-first growth on a pool of leaf histograms, gradient-based one-side sampling.

Features are binned once a fit, and a row's leaf is an expression of its bins, so rows are never copied or moved. A step is
one job: the sums by bin of the smaller children of the leaves of largest gain, whose size does not depend on the rows.
Tables of at most LOCAL_TRAIN_ROWS rows take the same rounds in one task, on the same pool.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators.binning import binned
from ..operators.sampling import goss
from ..operators.splits import Search, best_splits, with_edges
from . import grow, local_boost
from .boosting import CUT_EVERY, PREDICTION, RESIDUAL, mean_loss, should_stop
from .model import Ensemble, Node, Tree, arrays, walk
from .pool import MEASURES, grow_leaves, node_of
from .store import Rolling, scope

#: Leaves whose children are counted in one job.
AHEAD = 16
#: Leaves up to which a row's leaf is a nested condition; beyond, a walk of arrays.
CASE_LEAVES = 64


@dataclass(frozen=True)
class LeafwiseConfig:
    rounds: int = 100
    rate: float = 0.1
    leaves: int = 31
    min_data: int = 20
    min_gain: float = 0.0
    max_depth: int = -1
    lam: float = 0.0
    top_rate: float = 0.2
    other_rate: float = 0.1
    use_goss: bool = True
    max_bin: int = 255
    finder: str = ""
    patience: int = 0
    tolerance: float = 1e-7
    seed: int = 42
    #: Small tables and nodes grow in one task; the trees are the same.
    local: bool = True


def leaf_of(tree: Tree, s: Search, value=lambda n: n.node_id) -> Column:
    """The leaf of each row (or another number of it) from the row's bins, or its values where the finder does not bin."""
    names = [f"b{k}" for k in range(len(s.features))] if s.binned else s.features
    bounds = {k: grow.compared(n, s)[1] for k, n in tree.items() if not n.is_leaf}
    if sum(n.is_leaf for n in tree.values()) <= CASE_LEAVES:

        def case(k: int) -> str:
            n = tree[k]
            return f"{float(value(n))!r}D" if n.is_leaf else f"CASE WHEN CAST(`{names[n.feature]}` AS DOUBLE) <= {float(bounds[k])!r}D THEN {case(n.left)} ELSE {case(n.right)} END"

        return F.expr(case(0))
    packed, of = arrays({k: replace(n, threshold=float(bounds[k])) if k in bounds else n for k, n in tree.items()}), [value(tree[k]) for k in sorted(tree)]

    @F.pandas_udf("double")
    def found(*cols: pd.Series) -> pd.Series:
        return pd.Series(np.array(of, float)[walk(packed, np.column_stack([c.to_numpy(float) for c in cols]))])

    return found(*(F.col(c).cast("double") for c in names))


def leaf_wise(rows: DataFrame, s: Search, config: LeafwiseConfig) -> Tree:
    """Splits the leaf of largest gain until there are enough leaves. A child with few rows stays a leaf. rows: label, weight, and features or their bins."""
    rows = grow.labelled(rows, s.label)
    if not s.binned and (s := with_edges(rows, s)).edges:
        rows, s = binned(rows, s.features, s.edges, [s.label, s.weight]), replace(s, binned=True)
    names = [f"b{k}" for k in range(len(s.features))] if s.binned else [*dict.fromkeys(s.features)]
    now = rows.select(*names, F.col(s.label).cast("double").alias("_y"), F.col(s.weight).cast("double").alias("_w")).persist()
    try:
        if not s.binned:
            return grow.below(by_values(now, replace(s, label="_y", weight="_w"), config), 0)
        offsets = np.cumsum([0, *(max(1, len(s.edges[k])) for k in range(len(s.features)))])
        return grow.below(grow_leaves(lambda tree, leaves: histograms(now, tree, leaves, s, offsets), offsets, s.edges, config, AHEAD), 0)
    finally:
        now.unpersist()


def histograms(now: DataFrame, tree: Tree, leaves: list[int], s: Search, offsets: np.ndarray) -> dict[int, np.ndarray]:
    """Sums by bin of the rows of these leaves: one job, whose rows are leaves times bins at most."""
    mine = now.select("*", leaf_of(tree, s).cast("int").alias("leaf")).where(F.col("leaf").isin(leaves))
    each = ", ".join(f"struct({k} AS feature, b{k} AS bin)" for k in range(len(s.features)))
    flat = mine.selectExpr("leaf", "_w", "_w * _y AS _wy", "_w * _y * _y AS _wyy", f"inline(array({each}))")
    got = flat.groupBy("leaf", "feature", "bin").agg(F.sum("_w").alias("a"), F.sum("_wy").alias("b"), F.sum("_wyy").alias("c"), F.count(F.lit(1)).alias("r")).toArrow()
    leaf, cell = got["leaf"].to_numpy(), offsets[got["feature"].to_numpy()] + got["bin"].to_numpy()
    out = {k: np.zeros((MEASURES, int(offsets[-1]))) for k in np.unique(leaf).tolist()}
    for k, h in out.items():
        at = np.flatnonzero(leaf == k)
        for m, c in enumerate("abcr"):
            h[m, cell[at]] = got[c].to_numpy()[at]
    return out


def by_values(now: DataFrame, s: Search, config: LeafwiseConfig) -> Tree:
    """The same growth for finders that do not bin: the children of a leaf are searched from its rows, a job a step."""
    w, y = F.col(s.weight), F.col(s.label)
    whole = now.agg(F.sum(w), F.sum(w * y), F.sum(w * y * y), F.count(F.lit(1))).first()
    if not whole[3]:
        return {0: Node(0, 0)}
    planned, rows_of, found = {0: node_of(0, 0, np.array(whole, float), config.lam)}, {0: whole[3]}, {}
    tree, n_leaves, heap = {0: replace(planned[0])}, 1, []

    def offer(leaves: list[int]) -> None:
        ok = [k for k in leaves if rows_of[k] >= 2 * config.min_data and not 0 <= config.max_depth <= planned[k].depth]
        mine = now.withColumn(s.node, leaf_of(planned, s).cast("int")).where(F.col(s.node).isin(ok))
        for r in best_splits(mine, s, None, True).collect() if ok else []:  # a row a leaf
            if r["gain"] > config.min_gain:
                found[r[s.node]] = r
                heapq.heappush(heap, (-r["gain"], r[s.node]))

    offer([0])
    while heap and n_leaves < config.leaves:
        _, k = heapq.heappop(heap)
        r, t, a = found[k], planned[k], len(planned)
        t.is_leaf, t.feature, t.threshold, t.gain, t.left, t.right = False, r["feature"], r["threshold"], r["gain"], a, a + 1
        for c, left in ((a, True), (a + 1, False)):
            sums = np.array([r[f"l{x}"] if left else r[f"t{x}"] - r[f"l{x}"] for x in "abcr"], float)
            planned[c], rows_of[c] = node_of(c, t.depth + 1, sums, config.lam), sums[3]
        tree |= {x: replace(planned[x]) for x in (k, a, a + 1)}
        n_leaves += 1
        offer([a, a + 1])
    return tree


def train(rows: DataFrame, features: list[str], label: str, row_id: str, config: LeafwiseConfig = LeafwiseConfig(), validation: DataFrame | None = None) -> Ensemble:
    """Stops early on the validation loss, or on the training loss where there is none. Rows without a finite label take no part."""
    rows = grow.labelled(rows, label)
    n, base = rows.agg(F.count(F.lit(1)), F.avg(label)).first()
    model = Ensemble(features, base=base or 0.0)
    if not n:
        return model
    source = rows.select(row_id, F.col(label).cast("double").alias(label), *(c for c in features if c not in (row_id, label)))
    search = with_edges(source.persist(), Search(features=features, label=RESIDUAL, weight="w", finder=config.finder or f"histogram_ew:{config.max_bin}", seed=config.seed))
    if config.local and n <= local_boost.LOCAL_TRAIN_ROWS and validation is None and search.edges:
        source.unpersist()
        return local_boost.train_leaf_wise(source, features, label, row_id, config, search, base, lambda losses: should_stop(losses, config.patience, config.tolerance))
    if search.edges:
        table, search = Rolling(binned(source, features, search.edges, [row_id, label]).withColumn(PREDICTION, F.lit(base))), replace(search, binned=True)
    else:
        table = Rolling(source.withColumn(PREDICTION, F.lit(base)))
    losses: list[float] = []
    for i in range(config.rounds):
        with scope():
            resid = table.now.withColumn(RESIDUAL, F.col(label) - F.col(PREDICTION))
            train_loss = resid.agg(F.avg(0.5 * F.col(RESIDUAL) * F.col(RESIDUAL))).first()[0] or 0.0
            table.settled()
            source.unpersist()
            sampled = goss(resid, RESIDUAL, row_id, config.top_rate, config.other_rate, config.seed + i, True, n) if config.use_goss else resid.withColumn("w", F.lit(1.0))
            tree = leaf_wise(sampled, search, config)
        model.add(tree, 1.0, config.rate)
        table.replace(table.now.withColumn(PREDICTION, F.col(PREDICTION) + config.rate * leaf_of(tree, search, lambda x: x.prediction)), (i + 1) % CUT_EVERY == 0)
        model.history.append({"iter": i, "train_loss": train_loss, "lr": config.rate, "n_dropped": 0})
        losses.append(mean_loss(model.score(validation, PREDICTION), exprs.squared(), label, PREDICTION) if validation is not None else train_loss)
        if should_stop(losses, config.patience, config.tolerance):
            break
    table.close()
    return model
