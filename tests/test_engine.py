"""Trees, splits, pruners and ensembles against small in-memory versions and invariants."""

import dataclasses
import math
import random

import pytest
from pyspark.sql import functions as F

from coppice.functions import criteria, exprs
from coppice.operators import binning, bundling, prune, sampling, splits
from coppice.operators.splits import Search
from coppice.plans import bagging, boosting, grow, leafwise, local_boost, model, newton, registry

FEATURES = ["f0", "f1"]


def data(n=300, seed=1, noise=0.5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = float(r.randint(0, 20)), round(r.uniform(0, 5), 2)
        rows.append((i, a, b, (10.0 if a > 12 else 0.0) + (3.0 if b > 2.5 else 0.0) + noise * r.gauss(0, 1)))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(data(), "row_id bigint, f0 double, f1 double, label double").withColumn("node_id", F.lit(0)).cache()


def variance(ys):
    m = sum(ys) / len(ys)
    return sum((y - m) ** 2 for y in ys) / len(ys)


def gain_of(points, f, t):
    left, right = [y for *x, y in points if x[f] <= t], [y for *x, y in points if x[f] > t]
    if not left or not right:
        return -1.0
    return variance(left + right) - (variance(left) * len(left) + variance(right) * len(right)) / len(points)


def brute_split(points, thresholds):
    found = [(gain_of(points, f, t), -f, -t) for f in range(2) for t in thresholds(f)]
    return max(found, default=None)


@pytest.mark.parametrize("finder", ["exhaustive", "quartile", "histogram_ew:8", "histogram_eq:8", "adaptive_ew:rice", "adaptive_ew:freedman_diaconis", "adaptive_eq", "random:7"])
def test_finders(rows, finder):
    points = [r[1:] for r in data()]
    s = splits.with_edges(rows, Search(features=FEATURES, finder=finder))
    got = splits.best_splits(rows, s).first()
    values = [sorted({p[f] for p in points}) for f in range(2)]
    if finder == "exhaustive":
        want = brute_split(points, lambda f: [(a + b) / 2 for a, b in zip(values[f], values[f][1:])])
        assert (got["feature"], got["threshold"]) == (-want[1], pytest.approx(-want[2]))
    elif finder == "quartile":
        want = brute_split(points, lambda f: [sorted(p[f] for p in points)[math.floor(q * (len(points) - 1))] for q in (0.25, 0.5, 0.75)])
    elif s.edges:
        want = brute_split(points, lambda f: s.edges[f])
    else:
        want = (gain_of(points, got["feature"], got["threshold"]),)
    assert got["gain"] == pytest.approx(want[0], rel=1e-9) and got["n_left"] + got["n_right"] == len(points)
    assert got["n_left"] == sum(p[got["feature"]] <= got["threshold"] for p in points)


@pytest.mark.parametrize("criterion", ["mae", "huber", "quantile:0.25", "logcosh", "poisson"])
def test_criterion_splits_and_metrics(rows, criterion):
    got = splits.best_splits(rows, Search(features=FEATURES, finder="quartile", criterion=criterion)).first()
    assert got is not None and got["gain"] > 0
    metric = criteria.node_metric(rows, ["node_id"], "label", criterion).first()
    ys = sorted(r[3] for r in data())
    mean = sum(ys) / len(ys)
    if criterion == "mae":
        med = (ys[len(ys) // 2 - 1] + ys[len(ys) // 2]) / 2
        assert metric["metric"] == pytest.approx(sum(abs(y - med) for y in ys) / len(ys))
    if criterion.startswith("quantile"):
        c = ys[math.floor(0.25 * (len(ys) - 1))]
        assert metric["metric"] == pytest.approx(sum((y - c) * (-0.75 if y < c else 0.25) for y in ys) / len(ys))
    if criterion == "logcosh":
        assert metric["metric"] == pytest.approx(sum(math.log(math.cosh(y - mean)) for y in ys) / len(ys))


def same_tree(a, b):
    return {(n.depth, n.is_leaf, n.feature, round(n.threshold, 9), n.samples, round(n.prediction, 9)) for n in a.values()} == {(n.depth, n.is_leaf, n.feature, round(n.threshold, 9), n.samples, round(n.prediction, 9)) for n in b.values()}


@pytest.fixture(scope="module")
def gaps(spark):
    """Rows with nulls and NaN in both features."""
    made = [(i, None if i % 7 == 0 else a, float("nan") if i % 11 == 0 else b, y) for i, a, b, y in data(400, 3)]
    return spark.createDataFrame(made, "row_id bigint, f0 double, f1 double, label double").withColumn("node_id", F.lit(0)).cache()


@pytest.mark.parametrize("min_leaf", [1, 6])
def test_rows_without_values_go_right_wherever_trees_grow(gaps, monkeypatch, min_leaf):
    s, growth = Search(features=FEATURES), grow.Growth(5, min_leaf)
    a = grow.level_wise(gaps, s, growth)
    b = grow.level_wise(gaps, s, grow.Growth(5, min_leaf, finish_locally=False))
    monkeypatch.setattr(grow, "FEW_NODES", 0)
    c = grow.level_wise(gaps, s, grow.Growth(5, min_leaf, finish_locally=False))
    assert same_tree(a, b) and same_tree(a, c) and len(a) > 5
    root, scored = b[0], tree_rows(gaps.sparkSession, b, gaps)
    assert b[root.left].samples == gaps.where(F.col(FEATURES[root.feature]) <= root.threshold).count()
    assert scored.where("prediction is null").count() == 0


@pytest.mark.parametrize("min_leaf", [1, 6])
def test_weights_count_in_min_leaf_wherever_trees_grow(gaps, monkeypatch, min_leaf):
    config = bagging.BaggingConfig(trees=3, max_depth=4, min_leaf=min_leaf)
    a, _ = bagging.train(gaps, FEATURES, "label", "row_id", config)
    monkeypatch.setattr(bagging, "TREE_ROWS", 0)
    b, _ = bagging.train(gaps, FEATURES, "label", "row_id", config)
    monkeypatch.setattr(grow, "LOCAL_ROWS", 0)
    c, _ = bagging.train(gaps, FEATURES, "label", "row_id", config)
    for x, y, z in zip(a.trees, b.trees, c.trees, strict=True):
        assert same_tree(x, y) and same_tree(x, z)
        assert all(n.samples >= min_leaf for n in x.values())


@pytest.mark.parametrize("objective", ["reg:squarederror", "binary:logistic"])
def test_gaps_boost_alike(gaps, monkeypatch, objective):
    binary = gaps.withColumn("label", (F.col("label") > 5).cast("double"))
    config = newton.NewtonConfig(objective=objective, rounds=2, max_depth=3)
    a = newton.train(binary, FEATURES, "label", "row_id", config)
    monkeypatch.setattr(local_boost, "LOCAL_TRAIN_ROWS", 0)
    monkeypatch.setattr(grow, "LOCAL_ROWS", 0)
    b = newton.train(binary, FEATURES, "label", "row_id", config)
    assert all(same_tree(x, y) for x, y in zip(a.trees, b.trees, strict=True))


def test_draws_are_a_bootstrap(spark):
    n = 15_000
    drawn = sampling.bootstrap(spark.range(n).withColumnRenamed("id", "row_id"), "row_id", 3).groupBy("tree_id").agg(F.count(F.lit(1)).alias("different"), F.max("w").alias("most"), F.sum("w").alias("all"), F.count_if(F.col("w") == 1).alias("once")).collect()
    for r in drawn:
        assert r["all"] == n and abs(r["different"] / n - (1 - math.exp(-1))) < 0.01 and 5 <= r["most"] <= 12 and abs(r["once"] / n - math.exp(-1)) < 0.015
    far = spark.createDataFrame([(2**62 + k,) for k in range(2000)], "row_id bigint")
    us = sorted(r[0] for r in far.select(splits.uniform(F.lit(1), F.col("row_id"))).collect())
    assert len(set(us)) == 2000 and max(abs(u - k / 2000) for k, u in enumerate(us)) < 0.045
    steps = [b - a for a, b in zip(us, us[1:])]
    assert len({round(x, 9) for x in steps}) > 1900


def test_level_wise_equals_local_growth(rows):
    s = Search(features=FEATURES)
    a = grow.level_wise(rows, s, grow.Growth(4, 5, finish_locally=False))
    b = grow.level_wise(rows, s, grow.Growth(4, 5))
    assert same_tree(a, b)
    for n in a.values():
        if not n.is_leaf:
            assert n.samples == a[n.left].samples + a[n.right].samples and n.gain > 0
    assert sum(n.samples for n in a.values() if n.is_leaf) == 300


@pytest.mark.parametrize("rows_", [[], [(0, 1.0, 1.0, 5.0)], [(i, 1.0, 1.0, float(i)) for i in range(9)], [(i, float(i), 0.0, 4.0) for i in range(9)], [(i, float(i), None, float(i)) for i in range(3)]])
def test_degenerate_rows(spark, rows_):
    df = spark.createDataFrame(rows_, "row_id bigint, f0 double, f1 double, label double")
    for finder in ("exhaustive", "quartile", "histogram_eq:64", "histogram_ew:4", "adaptive_eq"):
        tree = grow.train_tree(df, FEATURES, finder=finder, max_depth=3, min_leaf=2)
        assert len(tree) == 1 and tree[0].samples == len(rows_)
    stats = binning.equal_frequency(df, FEATURES, 64)
    assert all(len(v) <= max(1, len(rows_)) for v in stats.values())


def tree_rows(spark, tree, rows):
    made = model.Ensemble(FEATURES)
    made.add(tree)
    return made.score(rows)


def test_scorers_agree(spark, rows, monkeypatch):
    tree = grow.train_tree(rows, FEATURES, max_depth=6, min_leaf=2)
    a = [r["prediction"] for r in tree_rows(spark, tree, rows).orderBy("row_id").collect()]
    monkeypatch.setattr(model, "CASE_LEAVES", 0)
    b = [r["prediction"] for r in tree_rows(spark, tree, rows).orderBy("row_id").collect()]
    assert a == pytest.approx(b)
    back = model.read_nodes(model.node_table(spark, list(tree.values())))[0]
    assert same_tree(back, tree)


def test_pruners(rows):
    full = grow.train_tree(rows, FEATURES, max_depth=6, min_leaf=2)
    assert len(grow.train_tree(rows, FEATURES, max_depth=6, min_leaf=2, pruner="mingain", prune_param=1.0)) < len(full)
    some = grow.train_tree(rows, FEATURES, max_depth=6, min_leaf=2, pruner="cost_complexity", prune_param=20.0)
    assert 1 < len(some) < len(full)
    for n in some.values():
        if n.is_leaf:
            assert n.prediction == n.node_mean
    one = {k: model.Node(**vars(n)) for k, n in full.items()}
    prune.cost_complexity(one, 1e12)
    assert len(one) == 1 and one[0].is_leaf
    sums = grow.validation_sums(full, rows, FEATURES, "label")
    assert sums[0][0] == 300 and sum(sums[k][0] for k, n in full.items() if n.is_leaf and k in sums) == 300
    train, validation = rows.where("row_id < 200"), rows.where("row_id >= 200")
    error = lambda t: criteria.evaluate(tree_rows(rows.sparkSession, t, validation)).first()["mse"]
    grown = grow.train_tree(train, FEATURES, max_depth=8, min_leaf=1)
    pruned = grow.train_tree(train, FEATURES, max_depth=8, min_leaf=1, pruner="reduced_error", validation=validation)
    assert len(pruned) < len(grown) and error(pruned) <= error(grown) + 1e-9


def test_boosting_lowers_the_loss(rows):
    made = boosting.train(rows, FEATURES, "label", "row_id", boosting.BoostingConfig(rounds=4, max_depth=2, rate=0.5))
    losses = [h["train_loss"] for h in made.history]
    assert losses == sorted(losses, reverse=True)
    for loss in ("huber:2", "absolute", "quantile:0.3"):
        searched = boosting.train(rows, FEATURES, "label", "row_id", boosting.BoostingConfig(loss=loss, rounds=1, max_depth=1, line_search=True))
        assert 0 <= searched.rates[0] <= 1


def test_dart_without_drops_is_boosting(rows):
    plain = boosting.train(rows, FEATURES, "label", "row_id", boosting.BoostingConfig(rounds=3, max_depth=2))
    same = boosting.train(rows, FEATURES, "label", "row_id", boosting.BoostingConfig(rounds=3, max_depth=2, dart=True, drop_rate=0.0))
    assert all(same_tree(a, b) for a, b in zip(plain.trees, same.trees))
    drop = boosting.train(rows, FEATURES, "label", "row_id", boosting.BoostingConfig(rounds=3, max_depth=2, dart=True, drop_rate=0.9, normalise="original"))
    assert any(h["n_dropped"] for h in drop.history)


def test_dart_weights():
    for how, last, first in (("none", 1.0, 1.0), ("mild", 0.1 * 1.1, 1.0), ("original", 0.3, 1.5), ("experimental", 0.1 * (1 + 1.0 / 3), 1.0)):
        made = model.Ensemble(FEATURES)
        for _ in range(3):
            made.add({0: model.Node(0, 0)}, 1.0, 0.1)
        boosting.reweight(made, [0, 1], how, 0.1)
        assert made.weights[-1] == pytest.approx(last) and made.weights[0] == pytest.approx(first)


def test_newton(rows):
    made = newton.train(rows, FEATURES, "label", "row_id", newton.NewtonConfig(rounds=3, max_depth=3))
    losses = [h["train_loss"] for h in made.history]
    assert losses == sorted(losses, reverse=True)
    assert all(n.gain > 5 for t in newton.train(rows, FEATURES, "label", "row_id", newton.NewtonConfig(rounds=1, gamma=5.0)).trees for n in t.values() if not n.is_leaf)
    approx = newton.train(rows, FEATURES, "label", "row_id", newton.NewtonConfig(rounds=1, max_depth=2, approximate=True, max_bins=16, alpha=1.0, subsample=0.5, colsample=0.5))
    assert len(approx.trees) == 1
    binary = rows.withColumn("label", (F.col("label") > 5).cast("double"))
    scored = newton.probability(newton.train(binary, FEATURES, "label", "row_id", newton.NewtonConfig(objective="binary:logistic", rounds=2, max_depth=2)).score(binary))
    assert scored.where("proba < 0 or proba > 1").count() == 0
    with pytest.raises(ValueError):
        newton.NewtonConfig(eta=0)
    with pytest.raises(ValueError):
        registry.objective("reg:squaredlogerror")


def strict_best_first(points, leaves, min_data):
    """Leaf count and total squared error of best-first growth in memory."""
    open_, done = [points], []

    def best(part):
        vals = [sorted({p[f] for p in part}) for f in range(2)]
        return brute_split(part, lambda f: [(a + b) / 2 for a, b in zip(vals[f], vals[f][1:])]) if len(part) >= 2 * min_data else None

    while open_ and len(open_) + len(done) < leaves:
        scored = [(best(p), p) for p in open_]
        done += [p for b, p in scored if b is None or b[0] <= 0]
        scored = [(b, p) for b, p in scored if b is not None and b[0] > 0]
        if not scored:
            open_ = []
            break
        top = max(scored, key=lambda x: x[0])
        open_ = [p for b, p in scored if p is not top[1]]
        (_, f, t), part = top
        open_ += [[p for p in part if p[-f] <= -t], [p for p in part if p[-f] > -t]]
    out = open_ + done
    return len(out), sum(variance([p[-1] for p in x]) * len(x) for x in out)


def test_leaf_wise_is_best_first(spark, rows):
    s = Search(features=FEATURES, weight="w", finder="exhaustive")
    tree = leafwise.leaf_wise(rows.withColumn("w", F.lit(1.0)), s, leafwise.LeafwiseConfig(leaves=7, min_data=10))
    scored = tree_rows(spark, tree, rows)
    n, sse = strict_best_first([r[1:] for r in data()], 7, 10)
    assert model.leaves(tree) == n
    assert criteria.evaluate(scored).first()["mse"] * 300 == pytest.approx(sse)


def test_leafwise_training(rows):
    made = leafwise.train(rows, FEATURES, "label", "row_id", leafwise.LeafwiseConfig(rounds=2, leaves=4, max_bin=16))
    assert made.history[1]["train_loss"] < made.history[0]["train_loss"]


def test_goss(rows):
    got = sampling.goss(rows.withColumn("g", F.col("label") - 5), "g", "row_id", 0.2, 0.1, normalise=True)
    k, m = sampling.goss_sizes(300, 0.2, 0.1)
    r = got.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).first()
    assert r["n"] == k + m and r["w"] == pytest.approx(300)
    assert sampling.goss(rows.withColumn("g", F.lit(1.0)), "g", "row_id", 0.9, 0.5).count() == 300
    assert sampling.adaptive_rates(3, 0.2, 0.1) == pytest.approx((0.3, 0.08)) and sampling.adaptive_rates(0.1, 0.2, 0.1) == pytest.approx((0.16, 0.12))


def test_bootstrap_and_bagging(spark, rows):
    config = bagging.BaggingConfig(trees=4, ratio=0.8, max_depth=4)
    counts = {r["tree_id"]: r["n"] for r in sampling.bootstrap(rows, "row_id", 4, 0.8).groupBy("tree_id").agg(F.sum("w").alias("n")).collect()}
    assert counts == {k: 240 for k in range(4)}
    made, ranked = bagging.train(rows, FEATURES, "label", "row_id", config)
    assert len(made.trees) == 4 and all(t[0].samples == 240 for t in made.trees)
    out = bagging.oob(made, ranked, "row_id", "label", config)
    seen = sampling.bootstrap(ranked, "row_id", 4, 0.8).groupBy("rn").agg(F.countDistinct("tree_id").alias("k"))
    free = ranked.join(seen, "rn", "left").where("coalesce(k, 0) < 4").count()
    assert out.count() == free and bagging.oob_error(made, ranked, "row_id", "label", config).first()["mse"] < 10
    assert sum(r["importance"] for r in made.importance(spark).collect()) == pytest.approx(1.0)
    assert bagging.assignment(10, 4) == [(3, 0), (3, 3), (2, 6), (2, 8)]


def test_big_bags_grow_over_the_cluster(rows, monkeypatch):
    config = bagging.BaggingConfig(trees=2, max_depth=3)
    a, _ = bagging.train(rows, FEATURES, "label", "row_id", config)
    monkeypatch.setattr(bagging, "TREE_ROWS", 0)
    b, _ = bagging.train(rows, FEATURES, "label", "row_id", config)
    assert all(same_tree(x, y) for x, y in zip(a.trees, b.trees))


def test_bundles(spark):
    df = spark.createDataFrame([(int(i % 10 == 0), int(i % 10 == 1), int(i % 10 in (0, 2)), i) for i in range(100)], "a int, b int, c int, d int")
    found = bundling.bundles(df, ["a", "b", "c", "d"], 0.0)
    groups = {b.features for b in found}
    assert (3,) in groups and not any({0, 2} <= set(g) for g in groups)
    rate = {(r["a"], r["b"]): r["conflict"] for r in bundling.conflicts(df, ["a", "b", "c", "d"]).collect()}
    assert rate[0, 1] == 0 and rate[0, 2] == pytest.approx(0.5)


def test_registry():
    assert registry.finder("histogram_ew") == ("histogram_ew", "64") and registry.finder("nonsense") == ("exhaustive", "")
    assert registry.loss("huber:2").name == "huber"
    with pytest.raises(ValueError):
        registry.loss("nonsense")


def test_log_cosh_does_not_overflow(spark):
    assert spark.range(1).select(exprs.log_cosh(F.lit(5000.0))).first()[0] == pytest.approx(5000 - math.log(2))


@pytest.mark.parametrize("loss", ["squared", "huber:2", "absolute", "quantile:0.3"])
def test_small_tables_boost_alike(rows, monkeypatch, loss):
    config = boosting.BoostingConfig(loss=loss, rounds=2, max_depth=2)
    a = boosting.train(rows, FEATURES, "label", "row_id", config)
    monkeypatch.setattr(local_boost, "LOCAL_TRAIN_ROWS", 0)
    b = boosting.train(rows, FEATURES, "label", "row_id", config)
    assert all(same_tree(x, y) for x, y in zip(a.trees, b.trees, strict=True))
    assert [h["train_loss"] for h in a.history] == pytest.approx([h["train_loss"] for h in b.history])


@pytest.mark.parametrize("objective", ["reg:squarederror", "binary:logistic"])
def test_small_tables_boost_alike_in_second_order(rows, monkeypatch, objective):
    binary = rows.withColumn("label", (F.col("label") > 5).cast("double"))
    config = newton.NewtonConfig(objective=objective, rounds=2, max_depth=2)
    a = newton.train(binary, FEATURES, "label", "row_id", config)
    monkeypatch.setattr(local_boost, "LOCAL_TRAIN_ROWS", 0)
    b = newton.train(binary, FEATURES, "label", "row_id", config)
    assert all(same_tree(x, y) for x, y in zip(a.trees, b.trees, strict=True))
    assert a.factors() == pytest.approx(b.factors())


def test_dropping_at_inference(rows):
    made = boosting.train(rows, FEATURES, "label", "row_id", boosting.BoostingConfig(rounds=3, max_depth=1))
    config = boosting.BoostingConfig(dart=True, drop_rate=0.9, skip_drop_for_prediction=False)
    total = lambda df: df.agg(F.sum(F.col("prediction") * F.col("prediction"))).first()[0]
    assert total(boosting.predict(made, rows, config)) != pytest.approx(total(boosting.predict(made, rows, dataclasses.replace(config, skip_drop_for_prediction=True))))


@pytest.mark.parametrize("finder", ["exhaustive", "quartile", "adaptive_eq"])
def test_values_of_one_feature_over_many_tasks(gaps, finder):
    """Running sums by ranges give the splits that a window gives."""
    rows = gaps.withColumn("node_id", (F.col("row_id") % 3).cast("int")).repartition(5)
    s = Search(features=FEATURES, finder=finder)
    a, b = (sorted(map(tuple, splits.best_splits(rows, x).collect())) for x in (s, dataclasses.replace(s, many_values=True)))
    assert len(a) == 3 and all(x == pytest.approx(y) for x, y in zip(a, b, strict=True))


def test_running_sums(spark):
    from coppice.plans.ranking import running

    r = random.Random(6)
    made = [(g, None if v == 0 else float(v), r.randint(1, 9)) for g in range(3) for v in range(40)]
    got = {(x["g"], x["v"]): x for x in running(spark.createDataFrame(made, "g int, v double, n int").repartition(7), ["g"], "v", ["n"], "v").collect()}
    for g in range(3):
        order = sorted((x for x in made if x[0] == g), key=lambda x: (x[1] is None, x[1]))
        upto = 0
        for k, (_, v, n) in enumerate(order):
            upto += n
            x = got[g, v]
            assert x["c_n"] == upto and x["t_n"] == sum(y[2] for y in order)
            assert x["nxt"] == (order[k + 1][1] if k + 1 < len(order) else None)


@pytest.mark.parametrize("pruner,param", [("mingain", 2.0), ("cost_complexity", 30.0), ("reduced_error", 0.0)])
def test_bagged_trees_are_pruned(rows, pruner, param):
    full, ranked = bagging.train(rows, FEATURES, "label", "row_id", bagging.BaggingConfig(trees=3, max_depth=6))
    config = bagging.BaggingConfig(trees=3, max_depth=6, pruner=pruner, prune_param=param)
    some, _ = bagging.train(rows, FEATURES, "label", "row_id", config)
    assert all(1 < len(a) < len(b) for a, b in zip(some.trees, full.trees, strict=True))
    if pruner == "reduced_error":
        assert bagging.oob_error(some, ranked, "row_id", "label", config).first()["mse"] <= bagging.oob_error(full, ranked, "row_id", "label", config).first()["mse"]


def test_importance_of_groups(spark, rows):
    made, _ = bagging.train(rows, FEATURES, "label", "row_id", bagging.BaggingConfig(trees=5, max_depth=3))
    of = []
    for count, first in bagging.assignment(5, 2):
        used = [n.feature for t in made.trees[first : first + count] for n in t.values() if not n.is_leaf]
        of.append([used.count(f) / len(used) for f in range(2)])
    got = {r["feature"]: r["importance"] for r in bagging.grouped_importance(made, spark, 2).collect()}
    assert [got[0], got[1]] == pytest.approx([(of[0][f] + of[1][f]) / 2 for f in range(2)])


def test_loss_of_boosting_and_validation_of_leaf_wise(spark, rows):
    config = boosting.BoostingConfig(loss="huber:2", rounds=2, max_depth=2)
    made = boosting.train(rows, FEATURES, "label", "row_id", config)
    got = boosting.evaluate(made, rows, "label", config).first()
    assert got["n"] == 300 and 0 < got["loss"] < got["mse"]
    total = model.ensemble_stats(made.nodes(spark)).first()
    assert total["trees"] == 2 and total["leaves"] == sum(map(model.leaves, made.trees))
    stopped = leafwise.train(rows, FEATURES, "label", "row_id", leafwise.LeafwiseConfig(rounds=4, leaves=3, max_bin=8, patience=1, rate=1e-9), rows.limit(50))
    assert len(stopped.trees) < 4


def test_histograms_of_parts(rows):
    edges = binning.equal_width(rows, FEATURES, 8)
    whole, low, high = (binning.histogram(x, FEATURES, edges, "label") for x in (rows, rows.where("f0 <= 9"), rows.where("f0 > 9")))
    table = lambda h: sorted((r["feature"], r["bin"], r["cnt"], round(r["s1"], 6), round(r["c_s2"], 6)) for r in h.collect())
    assert table(binning.changed(low, high, 1)) == table(whole) and table(binning.changed(whole, high, -1)) == table(low)
    part = binning.range_stats(whole, 0, 2, 5).first()
    want = sum(r["cnt"] for r in whole.where("feature = 0 and bin >= 2 and bin < 5").collect())
    assert part["cnt"] == want and part["mse"] > 0 and binning.range_stats(whole, 0, 3, 3).first()["cnt"] == 0
    cache = binning.HistogramCache(1)
    assert cache.get("a", lambda: whole).count() == cache.get("a", lambda: low).count() and (cache.hits, cache.misses) == (1, 1)
    cache.get("b", lambda: low)
    assert list(cache.held) == ["b"]
    cache.clear()
    edges = binning.adaptive_frequency_edges(rows, FEATURES)
    assert all(len(e) >= 4 and e == sorted(set(e)) for e in edges.values())


@pytest.mark.parametrize("finder", ["histogram_ew:8", "histogram_eq:8"])
def test_larger_children_by_subtraction(gaps, monkeypatch, finder):
    s, growth = Search(features=FEATURES, finder=finder, weight="w"), grow.Growth(4, 3)
    weighted = gaps.withColumn("w", (F.col("row_id") % 3).cast("double"))
    a = grow.level_wise(weighted, s, growth)
    monkeypatch.setattr(grow, "child_sums", lambda hist, moved, s, *_: (moved.limit(0), splits.sums(moved, s, True)))
    b = grow.level_wise(weighted, s, growth)
    assert same_tree(a, b) and len(a) > 7


def test_draws_are_made_once_and_rows_laid_together_change_nothing(rows, monkeypatch):
    config = bagging.BaggingConfig(trees=3, max_depth=3, pruner="reduced_error")
    monkeypatch.setattr(bagging, "TREE_ROWS", 0)
    a, _ = bagging.train(rows, FEATURES, "label", "row_id", config)
    monkeypatch.setattr(grow, "SCATTERED_ROWS", 0)
    b, ranked = bagging.train(rows, FEATURES, "label", "row_id", config)
    assert all(same_tree(x, y) for x, y in zip(a.trees, b.trees))
    assert "md5" not in bagging.oob(b, ranked, "row_id", "label", config)._jdf.queryExecution().toString()
