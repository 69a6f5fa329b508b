"""Tree growth: level by level with all open nodes in one plan, and small nodes finished where their rows are."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.criteria import node_metric
from ..functions.exprs import finite
from ..operators import prune as pruners
from ..operators import splits as searching
from ..operators.binning import binned
from ..operators.splits import Search, additive, best_splits, siblings, sums, with_edges
from .model import NODES, Node, Tree

#: Rows up to which a node's whole subtree is grown in one task, and levels between checkpoints.
LOCAL_ROWS, CHECKPOINT_EVERY = 20_000, 8
#: Nodes up to which a table of them is sent to every executor.
BROADCAST_NODES = 100_000
#: Nodes up to which they are written into the plan instead; the rows are the same.
FEW_NODES = 64
#: Rows from which those with equal values of a feature are brought together first, and are held on disk, so that sorts and
#: sums have the memory: the rows are the same.
SCATTERED_ROWS = 1_000_000
CENTRED = "_centred"


@dataclass(frozen=True)
class Growth:
    max_depth: int = 800
    min_leaf: int = 2
    min_gain: float = 0.0
    finish_locally: bool = True


def labelled(rows: DataFrame, label: str) -> DataFrame:
    """The rows with a finite label: nothing is learned from others, on any path and at any size."""
    y = F.col(label).cast("double")
    return rows.where(y.isNotNull() & finite(y))


def totals(rows: DataFrame, s: Search) -> dict[int, tuple[int, float, float]]:
    """node -> rows, mean (or leaf weight), metric of the open nodes: a row a node comes to the driver."""
    if s.newton:
        g, h = (F.col(c) for c in s.newton)
        got = rows.groupBy(s.node).agg(F.count(F.lit(1)).alias("n"), F.sum(g).alias("g"), F.sum(h).alias("h")).collect()
        return {r[s.node]: (r["n"], -r["g"] / (r["h"] + s.lam) if r["h"] + s.lam > 0 else 0.0, r["h"]) for r in got}
    if s.weight:
        w, y = F.col(s.weight).cast("double"), F.col(s.label)
        got = rows.groupBy(s.node).agg(F.sum(w).alias("n"), F.sum(w * y).alias("a"), F.sum(w * y * y).alias("b")).collect()
        return {r[s.node]: (int(round(r["n"])), r["a"] / r["n"], max(0.0, r["b"] / r["n"] - (r["a"] / r["n"]) ** 2)) for r in got if r["n"]}
    return {r[s.node]: (r["samples"], r["node_mean"], r["metric"]) for r in node_metric(rows, [s.node], s.label, s.criterion).collect()}


def compared(n: Node, s: Search) -> tuple[Column, float]:
    """What a split compares: a column and the bound up to which rows go left (the bin's number where bins are made)."""
    if s.binned:
        edges = s.edges[n.feature]
        return F.col(f"b{n.feature}"), bisect_right(edges, n.threshold) - 1 if s.ranked else bisect_left(edges, n.threshold)
    return F.col(s.features[n.feature]).cast("double"), n.threshold


def route(tree: dict[int, Node], split: list[int], s: Search) -> Column:
    """The child of each row of the nodes just split; other rows keep their node."""
    out = F.col(s.node)
    cond = None
    for k in split:
        n = tree[k]
        value, bound = compared(n, s)
        goes = F.when(value <= bound, F.lit(n.left)).otherwise(F.lit(n.right))
        cond = F.when(F.col(s.node) == k, goes) if cond is None else cond.when(F.col(s.node) == k, goes)
    return out if cond is None else cond.otherwise(out).cast("int")


def of_nodes(rows: DataFrame, node: str, ids: list[int]) -> DataFrame:
    """The rows of these nodes, by a join with their ids where they are many."""
    if len(ids) <= FEW_NODES:
        return rows.where(F.col(node).isin(ids))
    table = rows.sparkSession.createDataFrame([(k,) for k in ids], f"`{node}` int")
    return rows.join(F.broadcast(table) if len(ids) <= BROADCAST_NODES else table, node, "left_semi")


def routed(rows: DataFrame, tree: Tree, split: list[int], s: Search) -> DataFrame:
    """The rows of the nodes just split, each at its child, by a join with the table of splits where they are many. Rows without a value go right."""
    if len(split) <= FEW_NODES:
        return rows.where(F.col(s.node).isin(split)).withColumn(s.node, route(tree, split, s))
    made = [(k, tree[k].feature, float(compared(tree[k], s)[1]), tree[k].left, tree[k].right) for k in split]
    table = rows.sparkSession.createDataFrame(made, f"`{s.node}` int, _f int, _t double, _l int, _r int")
    value = F.get(F.array(*((F.col(f"b{k}") if s.binned else F.col(c)).cast("double") for k, c in enumerate(s.features))), F.col("_f"))
    joined = rows.join(F.broadcast(table) if len(split) <= BROADCAST_NODES else table, s.node)
    return joined.withColumn(s.node, F.when(value <= F.col("_t"), F.col("_l")).otherwise(F.col("_r"))).select(*rows.columns)


def level_wise(rows: DataFrame, s: Search, growth: Growth) -> Tree:
    """One tree. Stops at depth, at fewer than 2 * min_leaf rows, without gain, or where the best split has a small side."""
    return forest(rows.withColumn(s.node, F.lit(0)), s, growth, 1)[0]


def child(k: int, depth: int, row, side: str, s: Search, centre: float) -> Node:
    """A child from what the search knows of its side of the split: no other look at the rows."""
    of = {c: row[f"l{c}"] if side == "left" else row[f"t{c}"] - row[f"l{c}"] for c in searching.measures(s)}
    n = int(round(of["n"]))
    if s.newton:
        value = -of["b"] / (of["a"] + s.lam) if of["a"] + s.lam > 0 else 0.0
        return Node(k, depth, n, of["a"], value, value)
    mean = of["b"] / of["a"]
    return Node(k, depth, n, max(0.0, of["c"] / of["a"] - mean * mean), centre + mean, centre + mean)


def forest(rows: DataFrame, s: Search, growth: Growth, roots: int) -> list[Tree]:
    """Trees grown together, a job a level for all: a row stands in the tree that its node column (0 to roots - 1) names.

    The sums by bin of a level come from those of the level above and the rows of the smaller children; they also tell what
    the nodes of the next level are. Criteria that are no sums take a job more a level.
    """
    for c in s.newton or (s.label,):
        rows = labelled(rows, c)
    s = with_edges(rows, s)
    known = totals(rows.withColumn(s.node, F.col(s.node).cast("int")), s)
    tree: Tree = {k: Node(k, 0, *known[k][:1], known[k][2], known[k][1], known[k][1]) if k in known else Node(k, 0) for k in range(roots)}
    # Sums of squares of labels near zero lose nothing.
    seen = sum(n.samples for n in tree.values())
    centre = sum(n.samples * n.node_mean for n in tree.values()) / seen if seen and additive(s) and not s.newton else 0.0
    if s.edges and additive(s) and not s.binned:
        rows, s = binned(rows, s.features, s.edges, [*rows.columns], s.ranked), replace(s, binned=True)
    if not s.newton:
        rows, s = rows.withColumn(CENTRED, F.col(s.label).cast("double") - centre), replace(s, label=CENTRED)
    held = [f"b{k}" for k in range(len(s.features))] if s.binned else [*dict.fromkeys(s.features)]
    now = rows.select(*held, *(c for c in dict.fromkeys([*(s.newton or (s.label,)), *([s.weight] if s.weight else [])]) if c not in held), F.col(s.node).cast("int").alias(s.node))
    if not s.edges and seen > SCATTERED_ROWS:
        now = now.hint("rebalance", F.col(most_values(rows, s.features)))
    level = StorageLevel.DISK_ONLY if seen > SCATTERED_ROWS else StorageLevel.MEMORY_AND_DISK_DESER
    now = now.persist(level)
    s = replace(s, many_values=(not s.edges or s.ranked) and seen * len(s.features) > searching.MANY_VALUES)
    open_nodes, depth, next_id, hist, old = list(range(roots)), 0, roots, None, []
    while open_nodes and depth < growth.max_depth:
        grow = [k for k in open_nodes if tree[k].samples >= max(2, 2 * growth.min_leaf)]
        if s.newton:
            grow = [k for k in grow if tree[k].metric >= s.min_child_weight]
        small = [k for k in grow if tree[k].samples <= LOCAL_ROWS] if growth.finish_locally and local_finder(s) else []
        if small:
            next_id = finish(of_nodes(now, s.node, small), s, growth, tree, next_id, centre)
            done = set(small)
            grow = [k for k in grow if k not in done]
        if not grow:
            break
        if s.binned and hist is None:
            hist = sums(of_nodes(now, s.node, grow), s, True).persist()
        found = best_splits(of_nodes(now, s.node, grow), s, None if hist is None else of_nodes(hist, s.node, grow), additive(s)).collect()  # a row an open node at most
        for x in old:
            x.unpersist()
        split, sizes = [], {}
        depth += 1
        for r in sorted(found, key=lambda r: r[s.node]):
            k = r[s.node]
            if r["gain"] < growth.min_gain or min(r["n_left"], r["n_right"]) < growth.min_leaf:
                continue
            t = tree[k]
            t.is_leaf, t.feature, t.threshold, t.gain, t.left, t.right = False, r["feature"], searching.bound(r, s), r["gain"], next_id, next_id + 1
            if additive(s):
                tree |= {c: child(c, depth, r, side, s, centre) for c, side in ((t.left, "left"), (t.right, "right"))}
            next_id += 2
            split.append(k)
            sizes[k] = (r["n_left"], r["n_right"])
        if not split:
            break
        if depth >= growth.max_depth and additive(s):
            break
        open_nodes = [c for k in split for c in (tree[k].left, tree[k].right)]
        moved = routed(now, tree, split, s)
        moved = moved.checkpoint(False) if depth % CHECKPOINT_EVERY == 0 and has_checkpoint(rows.sparkSession) else moved
        moved = moved.persist(level)
        if not additive(s):
            tree |= {k: Node(k, depth, n, metric, mean, mean) for k, (n, mean, metric) in totals(moved, s).items()}
        old = [now]
        if hist is not None:
            counted, children = child_sums(hist, moved, s, tree, sizes)
            old = [counted, hist, now]
            hist = children.persist()
        now = moved
    for x in (hist, *old[:-1], now, *old[-1:]):  # what reads another one goes before it: else it would be planned anew
        if x is not None:
            x.unpersist()
    return [below(tree, k) for k in range(roots)]


def most_values(rows: DataFrame, features: list[str]) -> str:
    """The feature of most different values: where rows that share one lie together, sums by value are small before they are shuffled."""
    counts = rows.agg(*(F.approx_count_distinct(F.col(c).cast("double")).alias(str(k)) for k, c in enumerate(features))).first()
    return features[max(range(len(features)), key=lambda k: counts[k])]


def child_sums(hist: DataFrame, moved: DataFrame, s: Search, tree: Tree, sizes: dict[int, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """(sums by bin of the smaller child of each split node, from the rows; those of all children, the larger by subtraction)."""
    small = {k: tree[k].left if left <= right else tree[k].right for k, (left, right) in sizes.items()}
    counted = sums(of_nodes(moved, s.node, list(small.values())), s, True).persist()
    table = moved.sparkSession.createDataFrame([(k, c, tree[k].left + tree[k].right - c) for k, c in small.items()], f"`{s.node}` int, _small int, _big int")
    parents = hist.join(F.broadcast(table) if len(small) <= BROADCAST_NODES else table, s.node)
    return counted, counted.unionByName(siblings(parents, counted, s))


def below(nodes: Tree, root: int) -> Tree:
    """The tree under a root, its nodes numbered anew in their order, the root 0."""
    ids, stack = [], [root]
    while stack:
        n = nodes[stack.pop()]
        ids.append(n.node_id)
        if not n.is_leaf:
            stack += [n.left, n.right]
    order = {k: i for i, k in enumerate(sorted(ids))}
    out: Tree = {}
    for k in sorted(ids):
        n = nodes[k]
        n.node_id = order[k]
        if not n.is_leaf:
            n.left, n.right = order[n.left], order[n.right]
        out[n.node_id] = n
    return out


def has_checkpoint(spark: SparkSession) -> bool:
    return spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def local_finder(s: Search) -> bool:
    return s.finder in ("exhaustive", "exact") and s.criterion == "mse" and s.allowed is None


def finish(rows: DataFrame, s: Search, growth: Growth, tree: Tree, next_id: int, centre: float = 0.0) -> int:
    """Grows the subtrees of small nodes in one job, each in the task that has its rows. centre: what labels lack."""
    features, node, label, weight, newton = s.features, s.node, s.label, s.weight, s.newton
    depth_of = {k: tree[k].depth for k in tree}
    names, values = features, []
    if s.binned:  # ranks stand for values
        names, values = [f"b{k}" for k in range(len(features))], [np.array(s.edges[k] or [np.nan], float) for k in range(len(features))]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf[node].iloc[0])
        w = pdf[weight].to_numpy(float) if weight else np.ones(len(pdf))
        x = pdf[names].to_numpy(float)
        if values:
            x = np.column_stack([np.where(np.isnan(c), np.nan, v[np.nan_to_num(c).astype(int)]) for c, v in zip(x.T, values, strict=True)])
        if newton:
            made = local_tree(x, pdf[newton[0]].to_numpy(float), w, growth, depth_of[k], (pdf[newton[1]].to_numpy(float), s.lam, s.gamma, s.min_child_weight))
        else:
            made = local_tree(x, pdf[label].to_numpy(float), w, growth, depth_of[k])
        out = pd.DataFrame([vars(n) for n in made.values()])
        out["tree_id"] = k
        return out[[c.split()[0] for c in NODES.split(", ")]]

    keep = [node, *names, *([weight] if weight else []), *(newton or (label,))]
    got = rows.select(*dict.fromkeys(keep)).groupBy(node).applyInPandas(one, NODES).collect()  # nodes, fewer than rows of small nodes
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["tree_id"], []).append(r)
    for k in sorted(by):
        ids = {0: k}
        for r in sorted(by[k], key=lambda r: r["node_id"]):
            if r["node_id"]:
                ids[r["node_id"]] = next_id
                next_id += 1
        for r in by[k]:
            d = r.asDict() | {"tree_id": 0, "node_id": ids[r["node_id"]]}
            d["left"], d["right"] = ids.get(r["left"], -1) if not r["is_leaf"] else -1, ids.get(r["right"], -1) if not r["is_leaf"] else -1
            tree[d["node_id"]] = Node(**d | {"node_mean": d["node_mean"] + centre, "prediction": d["prediction"] + centre})
    return next_id


def local_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, growth: Growth, depth: int = 0, second: tuple | None = None) -> Tree:
    """The exhaustive finder in memory, with the same gains, ties and stops. second: hessian, lambda, gamma, least child weight; y is then the gradient."""
    tree: Tree = {}
    stack = [(0, depth, np.flatnonzero(w > 0))]
    next_id = 1
    while stack:
        k, d, at = stack.pop()
        wt, yt = w[at], y[at]
        n = int(round(wt.sum()))
        if second:
            h = second[0][at]
            mean = -yt.sum() / (h.sum() + second[1]) if h.sum() + second[1] > 0 else 0.0
            metric = float(h.sum())
        else:
            total = float(wt.sum())
            mean = float((wt * yt).sum() / total) if total else 0.0
            metric = float(max(0.0, (wt * (yt - mean) ** 2).sum() / total)) if total else 0.0
        tree[k] = Node(k, d, n, metric, float(mean), float(mean))
        if d >= growth.max_depth or n < max(2, 2 * growth.min_leaf) or second and metric < second[3]:
            continue
        best = local_split(x[at], yt, wt, None if not second else (second[0][at], *second[1:]), mean)
        if best is None or best[0] < growth.min_gain:
            continue
        gain, f, threshold = best
        goes = x[at, f] <= threshold
        if min(wt[goes].sum(), wt[~goes].sum()) < growth.min_leaf:
            continue
        t = tree[k]
        t.is_leaf, t.feature, t.threshold, t.gain, t.left, t.right = False, f, threshold, gain, next_id, next_id + 1
        stack += [(next_id + 1, d + 1, at[~goes]), (next_id, d + 1, at[goes])]
        next_id += 2
    return tree


def local_split(x: np.ndarray, y: np.ndarray, w: np.ndarray, second: tuple | None, mean: float) -> tuple[float, int, float] | None:
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        cut = np.flatnonzero(v[1:] > v[:-1] + 1e-12)
        if not len(cut):
            continue
        if second:
            h, lam, gamma, least = second
            b, a = np.cumsum(y[order]), np.cumsum(h[order])
            score = lambda g, k: np.where(k + lam > 0, 0.5 * g * g / np.maximum(k + lam, 1e-300), 0.0)
            gains = score(b[cut], a[cut]) + score(b[-1] - b[cut], a[-1] - a[cut]) - score(b[-1], a[-1])
            gains = np.where((a[cut] >= least) & (a[-1] - a[cut] >= least), gains, -np.inf)
            floor = gamma
        else:
            b, a = np.cumsum(w[order] * (y[order] - mean)), np.cumsum(w[order])
            gains = (b[cut] ** 2 / a[cut] + (b[-1] - b[cut]) ** 2 / (a[-1] - a[cut])) / a[-1] - (b[-1] / a[-1]) ** 2
            floor = 0.0
        i = int(np.argmax(gains))
        if gains[i] > floor and (best is None or gains[i] > best[0]):
            best = (float(gains[i]), f, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return best


def train_tree(rows: DataFrame, features: list[str], label: str = "label", finder: str = "exhaustive", criterion: str = "mse", max_depth: int = 800, min_leaf: int = 2, pruner: str = "none", prune_param: float = 0.01, validation: DataFrame | None = None, weight: str | None = None, local: bool = True) -> Tree:
    """A single regression tree, pruned: none, mingain (while growing), cost_complexity or reduced_error. Rows without a finite label take no part."""
    s = Search(features=features, label=label, finder=finder, criterion=criterion, weight=weight)
    rows = labelled(rows, label)
    tree = level_wise(rows, s, Growth(max_depth, min_leaf, prune_param if pruner == "mingain" else 0.0, local))
    if pruner == "cost_complexity":
        pruners.cost_complexity(tree, prune_param)
    elif pruner == "reduced_error":
        pruners.reduced_error(tree, validation_sums(tree, validation if validation is not None else rows, features, label))
    return tree


def validation_sums(tree: Tree, rows: DataFrame, features: list[str], label: str) -> dict[int, tuple[float, float, float]]:
    """n, sum and sum of squares of the labels that reach each node: one job by leaf, added up along the paths."""
    from .model import arrays, walk

    packed, ids = arrays(tree), np.array(sorted(tree))

    @F.pandas_udf("int")
    def leaf(*cols: pd.Series) -> pd.Series:
        return pd.Series(ids[walk(packed, np.column_stack([c.to_numpy(float) for c in cols]))]).astype("int32")

    y = F.col(label).cast("double")
    got = rows.select(leaf(*(F.col(c).cast("double") for c in features)).alias("k"), y.alias("y")).groupBy("k").agg(F.count("y").alias("n"), F.sum("y").alias("a"), F.sum(F.col("y") * F.col("y")).alias("b")).collect()
    parent = {c: k for k, n in tree.items() if not n.is_leaf for c in (n.left, n.right)}
    out: dict[int, tuple[float, float, float]] = {}
    for r in got:
        k = r["k"]
        while True:
            c = out.get(k, (0.0, 0.0, 0.0))
            out[k] = (c[0] + r["n"], c[1] + (r["a"] or 0.0), c[2] + (r["b"] or 0.0))
            if k not in parent:
                break
            k = parent[k]
    return out
