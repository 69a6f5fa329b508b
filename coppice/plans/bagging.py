"""Bagging: bootstrapped trees, mean vote, out-of-bag error, importances."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.criteria import evaluate
from ..operators import prune as pruners
from ..operators.sampling import DRAWN, with_bootstrap
from ..operators.splits import Search, with_edges
from . import grow
from .model import NODES, Ensemble, Node, arrays, walk

#: Bootstrap rows a tree up to which each tree is grown in one task of its own.
TREE_ROWS = 200_000


@dataclass(frozen=True)
class BaggingConfig:
    trees: int = 20
    ratio: float = 1.0
    max_depth: int = 10
    min_leaf: int = 2
    criterion: str = "mse"
    finder: str = "exhaustive"
    seed: int = 42
    #: none, mingain, cost_complexity, or reduced_error on the rows that a tree did not draw.
    pruner: str = "none"
    prune_param: float = 0.01
    #: Small tables and nodes grow in one task; the trees are the same.
    local: bool = True


def assignment(trees: int, workers: int) -> list[tuple[int, int]]:
    """(count, first tree) of each worker; the remainder goes to the first ones."""
    base, more = divmod(trees, workers)
    counts = [base + (k < more) for k in range(workers)]
    return [(c, sum(counts[:k])) for k, c in enumerate(counts)]


def train(rows: DataFrame, features: list[str], label: str, row_id: str, config: BaggingConfig = BaggingConfig()) -> tuple[Ensemble, DataFrame]:
    """(ensemble, numbered rows with rn and the trees that drew them). Trees whose bags fit in a task grow side by side, others together, level by level over the cluster. Rows without a finite label take no part."""
    rows = grow.labelled(rows, label)
    bag, ranked = with_bootstrap(rows.select(row_id, label, *features), row_id, config.trees, config.ratio, config.seed)
    growth = grow.Growth(config.max_depth, config.min_leaf, config.prune_param if config.pruner == "mingain" else 0.0, config.local)
    n = int(rows.count() * config.ratio)
    if config.local and n <= TREE_ROWS and config.finder in ("exhaustive", "exact") and config.criterion == "mse":
        trees, took = side_by_side(bag, features, label, growth)
    else:
        weight = "w"
        if config.criterion != "mse":  # other criteria look at single rows: a row drawn twice is there twice
            bag, weight = bag.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).drop("_again"), None
        s = with_edges(ranked, Search(features=features, label=label, weight=weight, finder=config.finder, criterion=config.criterion, seed=config.seed))
        began = time.perf_counter()
        trees = dict(enumerate(grow.forest(bag.withColumnRenamed("tree_id", s.node), s, growth, config.trees)))
        took = dict.fromkeys(trees, (time.perf_counter() - began) / config.trees)
    if config.pruner == "cost_complexity":
        for t in trees.values():
            pruners.cost_complexity(t, config.prune_param)
    elif config.pruner == "reduced_error":
        seen = out_of_bag_sums(trees, ranked, features, label, config)
        for k, t in trees.items():
            pruners.reduced_error(t, seen.get(k, {}))
    out = Ensemble(features, average=True)
    for k in range(config.trees):
        out.add(trees.get(k, {0: Node(0, 0)}))
        out.history.append({"tree": k, "draws": n, "seconds": took.get(k, 0.0)})
    return out, ranked


def worker_report(model: Ensemble, workers: int) -> list[dict]:
    """worker, trees, first, draws and seconds of the trees that assignment() deals to it. Trees grown side by side are timed in their tasks, trees grown together share their time."""
    out = []
    for w, (count, first) in enumerate(assignment(len(model.trees), workers)):
        mine = model.history[first : first + count]
        out.append({"worker": w, "trees": count, "first": first, "draws": sum(h["draws"] for h in mine), "seconds": sum(h["seconds"] for h in mine)})
    return out


def out_of_bag_sums(trees: dict[int, dict[int, Node]], ranked: DataFrame, features: list[str], label: str, config: BaggingConfig) -> dict[int, dict[int, tuple[float, float, float]]]:
    """For each tree, n, sum and sum of squares of the labels that reach each of its nodes, over the rows it did not draw: one job for all trees."""
    packed = [(k, np.array(sorted(trees[k])), arrays(trees[k])) for k in sorted(trees)]

    @F.pandas_udf("array<struct<tree_id:int,leaf:int>>")
    def leaves(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        at = [ids[walk(a, x)] for _, ids, a in packed]
        return pd.Series([[{"tree_id": k, "leaf": int(v[i])} for (k, _, _), v in zip(packed, at, strict=True)] for i in range(len(x))])

    each = ranked.select(F.coalesce(F.col(f"{DRAWN}.tree_id"), F.array()).alias("_seen"), F.col(label).cast("double").alias("y"), F.inline(leaves(*(F.col(c).cast("double") for c in features))))
    got = each.where(~F.array_contains("_seen", F.col("tree_id"))).groupBy("tree_id", "leaf").agg(F.count("y").alias("n"), F.sum("y").alias("a"), F.sum(F.col("y") * F.col("y")).alias("b")).collect()  # leaves
    out: dict[int, dict[int, tuple[float, float, float]]] = {}
    for r in got:
        tree = trees[r["tree_id"]]
        parent = {c: k for k, n in tree.items() if not n.is_leaf for c in (n.left, n.right)}
        of, k = out.setdefault(r["tree_id"], {}), r["leaf"]
        while k is not None:
            c = of.get(k, (0.0, 0.0, 0.0))
            of[k] = (c[0] + r["n"], c[1] + (r["a"] or 0.0), c[2] + (r["b"] or 0.0))
            k = parent.get(k)
    return out


def grouped_importance(model: Ensemble, spark: SparkSession, workers: int, by: str = "count") -> DataFrame:
    """feature, importance: the mean over groups of trees (as assignment() deals them out) of the groups' own normalised importances."""
    groups = [(t, w) for w, (count, first) in enumerate(assignment(len(model.trees), workers)) for t in range(first, first + count)]
    group = F.create_map(*(F.lit(x) for pair in groups for x in pair))[F.col("tree_id")]
    value = {"count": F.lit(1.0), "samples": F.col("samples").cast("double"), "gain": F.col("gain")}[by]
    used = model.nodes(spark).where(~F.col("is_leaf")).groupBy(group.alias("g"), "feature").agg(F.sum(value).alias("v"))
    share = used.join(used.groupBy("g").agg(F.sum("v").alias("t")), "g").where("t > 0").select("feature", (F.col("v") / F.col("t")).alias("s"))
    every = spark.range(len(model.features)).select(F.col("id").cast("int").alias("feature"))
    total = share.groupBy("feature").agg((F.sum("s") / min(workers, max(1, len(model.trees)))).alias("importance"))
    return every.join(F.broadcast(total), "feature", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def side_by_side(bag: DataFrame, features: list[str], label: str, growth: grow.Growth) -> tuple[dict[int, dict[int, Node]], dict[int, float]]:
    """(trees, seconds): each tree in one task; a bag is its distinct rows and how often they were drawn."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        made = grow.local_tree(pdf[features].to_numpy(float), pdf[label].to_numpy(float), pdf["w"].to_numpy(float), growth)
        out = pd.DataFrame([vars(n) for n in made.values()])
        out["tree_id"] = int(pdf["tree_id"].iloc[0])
        return out[[c.split()[0] for c in NODES.split(", ")]].assign(seconds=time.perf_counter() - began)

    got = bag.select("tree_id", "w", label, *features).groupBy("tree_id").applyInPandas(one, NODES + ", seconds double").collect()
    trees: dict[int, dict[int, Node]] = {}
    took: dict[int, float] = {}
    for r in got:
        d = r.asDict()
        took[d["tree_id"]] = d.pop("seconds")
        trees.setdefault(d["tree_id"], {})[d["node_id"]] = Node(**d)
    return trees, took


def oob(model: Ensemble, ranked: DataFrame, row_id: str, label: str, config: BaggingConfig) -> DataFrame:
    """row_id, label, prediction (mean of the trees that did not see the row) and n_trees, for rows with such trees."""
    packed = [arrays(t) for t in model.trees]

    @F.pandas_udf("struct<total:double,n_trees:int>")
    def free(drawn: pd.Series, *cols: pd.Series) -> pd.DataFrame:
        """Sum and number of the votes of trees that did not draw the row."""
        x = np.column_stack([c.to_numpy(float) for c in cols])
        counts = np.array([0 if d is None else len(d) for d in drawn])
        votes = np.ones((len(x), len(packed)))
        if counts.sum():
            votes[np.repeat(np.arange(len(x)), counts), np.concatenate([d for d in drawn if d is not None]).astype(int)] = 0
        total = np.zeros(len(x))
        for k, a in enumerate(packed):
            total += votes[:, k] * a[4][walk(a, x)]
        return pd.DataFrame({"total": total, "n_trees": votes.sum(1).astype("int32")})

    scored = ranked.withColumn("_f", free(F.col(f"{DRAWN}.tree_id"), *(F.col(c).cast("double") for c in model.features)))
    return scored.where("_f.n_trees > 0").select(row_id, label, (F.col("_f.total") / F.col("_f.n_trees")).alias("prediction"), F.col("_f.n_trees").alias("n_trees"))


def oob_error(model: Ensemble, ranked: DataFrame, row_id: str, label: str, config: BaggingConfig) -> DataFrame:
    """One row: n, mse and mae over rows that some tree did not see."""
    return evaluate(oob(model, ranked, row_id, label, config), label)
