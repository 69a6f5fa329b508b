"""Trees as flat node tables, ensembles of them, and how they score rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leaves up to which a tree is scored by nested conditions; deeper ones walk arrays in a pandas UDF.
CASE_LEAVES = 64
NODES = "tree_id int, node_id int, depth int, is_leaf boolean, feature int, threshold double, left int, right int, samples bigint, metric double, node_mean double, prediction double, gain double"


@dataclass
class Node:
    node_id: int
    depth: int
    samples: int = 0
    metric: float = 0.0
    node_mean: float = 0.0
    prediction: float = 0.0
    is_leaf: bool = True
    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1
    gain: float = 0.0
    tree_id: int = 0

    def make_leaf(self) -> None:
        self.is_leaf, self.feature, self.threshold, self.left, self.right, self.gain = True, -1, 0.0, -1, -1, 0.0
        self.prediction = self.node_mean


Tree = dict[int, Node]


@dataclass
class Ensemble:
    """base + sum(weight * rate * tree), or the mean of the trees."""

    features: list[str]
    trees: list[Tree] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    rates: list[float] = field(default_factory=list)
    base: float = 0.0
    average: bool = False
    history: list[dict] = field(default_factory=list)

    def add(self, tree: Tree, weight: float = 1.0, rate: float = 1.0) -> None:
        self.trees.append(tree)
        self.weights.append(weight)
        self.rates.append(rate)

    def factors(self) -> np.ndarray:
        f = np.array(self.weights) * np.array(self.rates) if self.trees else np.zeros(0)
        return f / len(f) if self.average and len(f) else f

    def score(self, rows: DataFrame, name: str = "prediction", trees: list[int] | None = None) -> DataFrame:
        """rows with the prediction; only the features are sent to the scorer."""
        chosen = list(range(len(self.trees))) if trees is None else trees
        factors = self.factors()
        return rows.withColumn(name, F.lit(self.base) + score_trees([self.trees[k] for k in chosen], [float(factors[k]) for k in chosen], self.features))

    def nodes(self, spark: SparkSession) -> DataFrame:
        return node_table(spark, [n for k, t in enumerate(self.trees) for n in numbered_nodes(t, k)])

    def importance(self, spark: SparkSession, by: str = "count") -> DataFrame:
        return importance(self.nodes(spark), len(self.features), by)


def numbered_nodes(tree: Tree, tree_id: int) -> list[Node]:
    for n in tree.values():
        n.tree_id = tree_id
    return list(tree.values())


def node_table(spark: SparkSession, nodes: list[Node]) -> DataFrame:
    names = [x.split()[0] for x in NODES.split(", ")]
    return spark.createDataFrame([tuple(asdict(n)[c] for c in names) for n in nodes], NODES)


def read_nodes(df: DataFrame) -> list[Tree]:
    """Trees of a node table."""
    trees: dict[int, Tree] = {}
    for r in df.collect():
        trees.setdefault(r["tree_id"], {})[r["node_id"]] = Node(**r.asDict())
    return [trees[k] for k in sorted(trees)]


def case_expression(tree: Tree, features: list[str], at: int = 0, value=lambda n: n.prediction) -> Column:
    n = tree[at]
    if n.is_leaf:
        return F.lit(value(n))
    goes = F.col(features[n.feature]).cast("double") <= n.threshold
    return F.when(goes, case_expression(tree, features, n.left, value)).otherwise(case_expression(tree, features, n.right, value))


def arrays(tree: Tree) -> tuple[np.ndarray, ...]:
    """feature (-1: leaf), threshold, left, right, prediction by position; the root is first."""
    order = {k: i for i, k in enumerate(sorted(tree))}
    ns = [tree[k] for k in sorted(tree)]
    link = lambda k, n: order[k] if not n.is_leaf else order[n.node_id]
    return (np.array([n.feature if not n.is_leaf else -1 for n in ns]), np.array([n.threshold for n in ns]), np.array([link(n.left, n) for n in ns]), np.array([link(n.right, n) for n in ns]), np.array([n.prediction for n in ns]))


def walk(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Position of the leaf of each row of x."""
    feature, threshold, left, right, _ = tree
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        f = feature[at[rows]]
        rows = rows[f >= 0]
        f = feature[at[rows]]
        goes = x[rows, f] <= threshold[at[rows]]
        at[rows] = np.where(goes, left[at[rows]], right[at[rows]])
    return at


def leaves(tree: Tree) -> int:
    return sum(n.is_leaf for n in tree.values())


def score_trees(trees: list[Tree], factors: list[float], features: list[str]) -> Column:
    """Sum of factor * prediction: nested conditions while small, else one vectorised walk of all trees."""
    if not trees:
        return F.lit(0.0)
    if sum(map(leaves, trees)) <= CASE_LEAVES:
        out = F.lit(0.0)
        for t, f in zip(trees, factors, strict=True):
            out = out + f * case_expression(t, features)
        return out
    packed = [(arrays(t), f) for t, f in zip(trees, factors, strict=True)]

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        total = np.zeros(len(x))
        for a, f in packed:
            total += f * a[4][walk(a, x)]
        return pd.Series(total)

    return score(*(F.col(c).cast("double") for c in features))


def importance(nodes: DataFrame, n_features: int, by: str = "count") -> DataFrame:
    """feature, importance: split counts, samples or gains of each feature over their total; 0 for unused features."""
    value = {"count": F.lit(1.0), "samples": F.col("samples").cast("double"), "gain": F.col("gain")}[by]
    used = nodes.where(~F.col("is_leaf")).groupBy("feature").agg(F.sum(value).alias("_v"))
    every = nodes.sparkSession.range(n_features).select(F.col("id").cast("int").alias("feature"))
    joined = every.join(F.broadcast(used), "feature", "left").withColumn("_v", F.coalesce("_v", F.lit(0.0)))
    total = used.agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_t"))
    return joined.crossJoin(F.broadcast(total)).select("feature", F.when(F.col("_t") > 0, F.col("_v") / F.col("_t")).otherwise(0.0).alias("importance"))


def top_importance(imp: DataFrame, k: int = 10) -> DataFrame:
    return imp.orderBy(F.desc("importance"), F.desc("feature")).limit(k)


def stats(nodes: DataFrame) -> DataFrame:
    """tree_id, depth, n_leaves, n_nodes."""
    return nodes.groupBy("tree_id").agg(F.max("depth").alias("depth"), F.count_if("is_leaf").alias("n_leaves"), F.count(F.lit(1)).alias("n_nodes"))


def ensemble_stats(nodes: DataFrame) -> DataFrame:
    """One row: trees, depths and leaves summed over them, nodes, and bytes of the node table (ten numbers of eight bytes a node)."""
    return stats(nodes).agg(F.count(F.lit(1)).alias("trees"), F.sum("depth").alias("depths"), F.sum("n_leaves").alias("leaves"), F.sum("n_nodes").alias("nodes"), (F.sum("n_nodes") * 80).alias("bytes"))
