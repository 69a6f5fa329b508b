"""Split search: the best threshold of every open node in one plan, whatever the finder.

Rows are summed by node, feature and value (or bin), running sums give both sides of every threshold, and the best gain
is kept by gain, then feature, then threshold. Labels should be centred (gains do not change, cancellation is less).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.criteria import node_metric
from ..functions.exprs import structure_score
from ..plans import registry
from ..plans.ranking import running
from . import binning

GAP = 1e-12
#: Values of all nodes and features up to which a node and feature is one task of a split search; the splits are the same.
MANY_VALUES = 5_000_000
#: Different values of all features together up to which they are ranked once and their ranks searched; the splits are the same.
RANKED_VALUES = 1_000_000


@dataclass(frozen=True)
class Search:
    """What is needed to search: names of columns and options. label, weight for variance; g, h for second order."""

    features: list[str]
    label: str = "label"
    node: str = "node_id"
    weight: str | None = None
    finder: str = "exhaustive"
    criterion: str = "mse"
    newton: tuple[str, str] | None = None
    lam: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    seed: int = 42
    edges: dict[int, list[float]] = field(default_factory=dict)
    #: Whether the rows have columns b0, b1, ... of bins made once (binning.binned), and whether a node and feature may have
    #: so many values that no one task should see them all (None: by the number of rows).
    binned: bool = False
    many_values: bool | None = None
    #: Whether edges are all values that occur (ranked_values) and bins their ranks: an exhaustive search on numbers made once.
    ranked: bool = False
    #: Each node searches only the features allowed to its tree: (tree column, expression of tree and feature).
    allowed: Column | None = None


def additive(s: Search) -> bool:
    """Whether sums by value tell all there is to know of a child."""
    return bool(s.newton) or s.criterion.partition(":")[0] in ("", "mse")


def measures(s: Search) -> list[str]:
    """a counts (or sums H), b sums labels (or G), n counts rows (or sums weights), c sums squared labels, r counts rows that have weights."""
    return ["a", "b", "n", *([] if s.newton else ["c"]), *(["r"] if s.weight else [])]


def sums(rows: DataFrame, s: Search, by_bin: bool) -> DataFrame:
    """node, feature, value and the measures. Rows without a value are one more group, at the right of every threshold."""
    keys = [s.node]
    w = F.col(s.weight).cast("double") if s.weight else F.lit(1.0)
    one, two = (F.col(s.newton[1]), F.col(s.newton[0])) if s.newton else (w, w * F.col(s.label))
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    number = lambda k, c: F.col(f"b{k}") if s.binned else binning.bin_of(known(c), s.edges[k])
    value = (lambda k, c: number(k, c).cast("double")) if by_bin else (lambda k, c: known(c))
    pairs = F.array(*(F.struct(F.lit(k).cast("int").alias("feature"), value(k, c).alias("value")) for k, c in enumerate(s.features)))
    flat = rows.select(*keys, one.alias("_a"), two.alias("_b"), w.alias("_w"), *([] if s.newton else [(two * F.col(s.label)).alias("_c")]), F.inline(pairs))
    if s.allowed is not None:
        flat = flat.where(s.allowed)
    count = F.sum("_w") if s.weight and not s.newton else F.count(F.lit(1))
    of = {"a": F.sum("_a"), "b": F.sum("_b"), "n": count, "c": None if s.newton else F.sum("_c"), "r": F.count(F.lit(1))}
    made = flat.groupBy(*keys, "feature", "value").agg(*(of[x].alias(x) for x in measures(s)))
    if not by_bin or s.binned:
        return made.withColumn("upper", F.col("value"))
    edges = ", ".join(binning.literal(s.edges.get(k, [])) for k in range(len(s.features)))
    return made.withColumn("upper", F.get(F.get(F.expr(f"array({edges})"), F.col("feature")), F.col("value").cast("int")))


def bound(r, s: Search) -> float:
    """The threshold of a row of best_splits(): the bin's upper edge where bins are made, whose number stands there then."""
    if not s.binned:
        return r["threshold"]
    edges = s.edges[r["feature"]]
    return (edges[int(r["threshold"])] + edges[int(r["nxt"])]) / 2 if s.ranked else edges[int(r["threshold"])]


def cumulative(made: DataFrame, s: Search) -> DataFrame:
    """With la, lb, ... (left of or at value), ta, tb, ... (all) of the measures, vn (those with a value) and nxt (the next value that occurs)."""
    of = measures(s)
    if s.many_values:
        made = made.withColumn("_v", F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
        out = running(made, [s.node, "feature"], "value", [*of, "_v"], "upper")
        return out.withColumnsRenamed({f"c_{x}": f"l{x}" for x in of} | {f"t_{x}": f"t{x}" for x in of} | {"t__v": "vn"}).drop("c__v", "_v")
    w = Window.partitionBy(s.node, "feature")
    order = w.orderBy(F.asc_nulls_last("value"))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    return made.withColumns({f"l{x}": F.sum(x).over(run) for x in of} | {f"t{x}": F.sum(x).over(w) for x in of} | {"vn": F.sum(known).over(w), "nxt": F.lead("upper").over(order)})


def gain(s: Search) -> Column:
    la, lb, ta, tb = (F.col(c) for c in ("la", "lb", "ta", "tb"))
    if s.newton:
        return structure_score(lb, la, s.lam) + structure_score(tb - lb, ta - la, s.lam) - structure_score(tb, ta, s.lam)
    some = lambda x: F.nullif(x, F.lit(0.0))  # noqa: E731  no gain where a side is empty
    return (lb * lb / some(la) + (tb - lb) * (tb - lb) / some(ta - la)) / some(ta) - (tb / some(ta)) * (tb / some(ta))


def siblings(parents: DataFrame, smaller: DataFrame, s: Search) -> DataFrame:
    """Sums by bin of the larger children: those of their parents less those of the smaller ones. parents: sums() with _big and _small, the children of each node; where these are null rows stay as they are."""
    of = measures(s)
    c = smaller.select(F.col(s.node).alias("_of"), F.col("feature").alias("_f"), F.col("value").alias("_v"), *(F.col(x).alias(f"_s_{x}") for x in of))
    both = parents.join(c, (F.col("_small") == F.col("_of")) & (F.col("feature") == F.col("_f")) & F.col("value").eqNullSafe(F.col("_v")), "left")
    less = both.select(F.coalesce("_big", s.node).alias(s.node), "feature", "value", *((F.col(x) - F.coalesce(F.col(f"_s_{x}"), F.lit(0))).alias(x) for x in of), "upper")
    return less.where(F.col("r") > 0 if s.weight else F.col("n") > 1e-9)


def candidates(rows: DataFrame, s: Search, made: DataFrame | None = None) -> DataFrame:
    """node, feature, threshold and the sums on either side, for every threshold the finder looks at. made: sums by bin, where they are known."""
    name, param = registry.finder(s.finder)
    if name in ("histogram_ew", "histogram_eq", "adaptive_ew") or s.ranked:
        return cumulative(sums(rows, s, True) if made is None else made, s).where("nxt is not null").withColumn("threshold", F.col("upper"))
    if s.many_values is None:
        s = replace(s, many_values=rows.count() * len(s.features) > MANY_VALUES)
    cum = cumulative(sums(rows, s, False), s)
    middle = (F.col("value") + F.col("nxt")) / 2
    apart = F.col("nxt") > F.col("value") + GAP
    if name == "quartile":
        hit = F.lit(False)
        for q in (0.25, 0.5, 0.75):
            rank = F.floor(q * (F.col("vn") - 1))
            hit = hit | ((F.col("ln") > rank) & (F.col("ln") - F.col("n") <= rank))
        return cum.where(hit & (F.col("vn") >= 4) & F.col("nxt").isNotNull()).withColumn("threshold", F.col("value"))
    if name == "adaptive_eq":
        least = 5
        keys = [s.node, "feature"]
        means = cum.groupBy(*keys).agg((F.sum(F.col("value") * F.col("n")) / F.max("vn")).alias("_mean"))
        about = cum.select(*keys, "value", "n", "vn").join(means, keys)
        squares = F.sum(F.col("n") * (F.col("value") - F.col("_mean")) * (F.col("value") - F.col("_mean"))) / F.max("vn")
        spread = cum.join(about.groupBy(*keys).agg((F.sqrt(squares) / (F.abs(F.first("_mean")) + GAP)).alias("_cv")), keys)
        root = F.sqrt(F.col("vn").cast("double"))
        most = int(param) if param else 64
        bins = F.when(F.col("_cv") < 0.1, F.least(F.greatest(F.floor(root / 2), F.lit(4)), F.lit(16))).otherwise(F.least(F.greatest(F.floor(root), F.lit(8)), F.lit(most)))
        bins = F.greatest(F.lit(2), F.least(bins, F.floor(F.col("vn") / least)))
        size = F.greatest(F.lit(least), F.floor(F.col("vn") / bins))
        return spread.withColumn("_size", size).where(apart & (F.col("vn") >= 2 * least) & (F.col("ln") % F.col("_size") == 0) & (F.col("ln") >= least) & (F.col("vn") - F.col("ln") >= least)).withColumn("threshold", middle)
    if name == "random":
        # The last value at or below a draw gives the sums at its left.
        ends = cum.groupBy(s.node, "feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        ranged = cum.join(ends, [s.node, "feature"])
        drawn = ranged.withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(int(param))))).withColumn("threshold", F.col("_lo") + uniform(F.col(s.node), F.col("feature"), F.col("_j"), s.seed) * (F.col("_hi") - F.col("_lo")))
        return drawn.where((F.col("_hi") - F.col("_lo") >= GAP) & (F.col("value") <= F.col("threshold")) & (F.col("nxt") > F.col("threshold")))
    return cum.where(apart).withColumn("threshold", middle)


def uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) from integers of any size: 52 bits of the MD5 of their decimal forms, which any SQL engine repeats."""
    text = F.concat_ws(":", *((F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def best_splits(rows: DataFrame, s: Search, made: DataFrame | None = None, sides: bool = False) -> DataFrame:
    """node, feature, threshold, gain, n_left, n_right (rows or weights): at most a row a node. Gains of zero or less are no split. sides: also la, ta, ... of the measures, for additive searches. Where bins are made (s.binned) the threshold is the bin's number."""
    found = candidates(rows, s, made)
    if s.criterion.partition(":")[0] not in ("", "mse") and registry.finder(s.finder)[0] in ("quartile", "adaptive_eq") and not s.newton:
        scored = by_criterion(rows, found.select(s.node, "feature", "threshold", "ln", "tn"), s)
    else:
        scored = found.withColumn("gain", gain(s))
        if s.newton:
            scored = scored.where((F.col("la") >= s.min_child_weight) & (F.col("ta") - F.col("la") >= s.min_child_weight))
    kept = scored.where(F.col("gain") > F.lit(s.gamma if s.newton else 0.0))
    # Largest gain, then least feature, then least threshold: one aggregate that is summed up where the rows are.
    rank = F.struct(F.col("gain"), -F.col("feature"), -F.col("threshold"))
    more = [*(f"{x}{c}" for c in measures(s) for x in "lt"), *(["nxt"] if s.ranked else [])] if sides else []
    best = kept.groupBy(s.node).agg(F.max_by(F.struct("feature", "threshold", "gain", *dict.fromkeys(["ln", "tn", *more])), rank).alias("_x")).select(s.node, "_x.*")
    return best.select(s.node, "feature", "threshold", "gain", *((x if s.weight else x.cast("bigint")).alias(c) for c, x in (("n_left", F.col("ln")), ("n_right", F.col("tn") - F.col("ln")))), *more)


def by_criterion(rows: DataFrame, found: DataFrame, s: Search) -> DataFrame:
    """Gains by the chosen criterion, for finders with few thresholds a node: each threshold's sides are groups of rows."""
    flat = binning.long_rows(rows, s.features, [s.node, s.label])
    sides = flat.join(found.select(s.node, "feature", "threshold"), [s.node, "feature"]).withColumn("_left", F.col("value") <= F.col("threshold"))  # a few thresholds a node and feature
    metric = node_metric(sides, [s.node, "feature", "threshold", "_left"], s.label, s.criterion)
    both = metric.groupBy(s.node, "feature", "threshold").agg(F.sum(F.col("metric") * F.col("samples")).alias("_children"), F.sum("samples").alias("_n"))
    parent = node_metric(rows, [s.node], s.label, s.criterion).select(s.node, F.col("metric").alias("_parent"))
    return found.join(both, [s.node, "feature", "threshold"]).join(parent, s.node).withColumn("gain", F.col("_parent") - F.col("_children") / F.col("_n"))


def ranked_values(rows: DataFrame, s: Search, most: int = RANKED_VALUES) -> Search:
    """The search by ranks of the values that occur, sorted once a fit, where an exhaustive search has at most so many; else the search as it is."""
    if registry.finder(s.finder)[0] != "exhaustive" or not additive(s) or s.allowed is not None:
        return s
    values = binning.long_rows(rows, s.features, []).where("value is not null and not isnan(value)")
    counts = values.groupBy("feature").agg(F.approx_count_distinct("value").alias("n")).collect()  # a row a feature
    if sum(r["n"] for r in counts) > 0.9 * most:
        return s
    edges: dict[int, list[float]] = {k: [] for k in range(len(s.features))}
    got = values.distinct().toArrow()  # about most numbers
    for k, v in zip(got["feature"].to_pylist(), got["value"].to_pylist(), strict=True):
        edges[k].append(v)
    return replace(s, edges={k: apart_values(sorted(v)) for k, v in edges.items()}, ranked=True)


def apart_values(values: list[float]) -> list[float]:
    """Sorted values without those that a search cannot part from the next one, whose rank they take."""
    return [v for v, after in zip(values, [*values[1:], None]) if after is None or after > v + GAP]


def with_edges(rows: DataFrame, s: Search) -> Search:
    """The search with bin edges from all rows, if its finder bins; done once a fit."""
    name, param = registry.finder(s.finder)
    if s.edges:
        return s
    if name == "histogram_ew":
        edges = binning.equal_width(rows, s.features, int(param))
    elif name == "histogram_eq":
        edges = binning.equal_frequency(rows, s.features, int(param))
    elif name == "adaptive_ew":
        edges = binning.equal_width_adaptive(rows, s.features, param)
    else:
        return s
    return replace(s, edges=edges)
