"""Labels that are no numbers, selection without a sort, the pool of histograms, tables that are freed."""

import dataclasses
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from coppice.functions import criteria
from coppice.operators import binning, sampling, splits
from coppice.operators.splits import Search
from coppice.plans import bagging, boosting, grow, leafwise, model, newton, store
from coppice.sources import matrix_csv

FEATURES = ["f0", "f1"]
SCHEMA = "row_id bigint, f0 double, f1 double, label double"


def data(n=400, seed=2):
    r = random.Random(seed)
    rows = [(k, float(r.randint(0, 30)), round(r.uniform(0, 5), 2)) for k in range(n)]
    return [(k, a, b, (8.0 if a > 11 else 0.0) + b * b + r.gauss(0, 0.4)) for k, a, b in rows]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(data(), SCHEMA).cache()


@pytest.fixture(scope="module")
def spoilt(spark):
    """The same rows and some without a finite label."""
    bad = [(1000 + k, 3.0, 1.0, y) for k, y in enumerate((None, math.nan, math.inf, -math.inf))]
    return spark.createDataFrame(data() + bad, SCHEMA).repartition(3).cache()


def nodes(tree):
    return sorted((n.depth, n.samples, n.feature, round(n.threshold, 6), round(n.prediction, 6), n.is_leaf) for n in tree.values())


def trained(kind, rows, local):
    if kind == "tree":
        return [grow.train_tree(rows, FEATURES, max_depth=3, min_leaf=5, local=local)]
    if kind == "histogram":
        return [grow.train_tree(rows, FEATURES, finder="histogram_ew:16", max_depth=4, min_leaf=5, local=local)]
    if kind == "mae":
        return [grow.train_tree(rows, FEATURES, finder="quartile", criterion="mae", max_depth=2, min_leaf=5, local=local)]
    if kind == "bagging":
        return bagging.train(rows, FEATURES, "label", "row_id", bagging.BaggingConfig(trees=2, max_depth=3, local=local))[0].trees
    if kind == "boosting":
        return boosting.train(rows, FEATURES, "label", "row_id", boosting.BoostingConfig(rounds=2, max_depth=2, local=local)).trees
    if kind == "newton":
        return newton.train(rows, FEATURES, "label", "row_id", newton.NewtonConfig(rounds=2, max_depth=2, local=local)).trees
    return leafwise.train(rows, FEATURES, "label", "row_id", leafwise.LeafwiseConfig(rounds=2, leaves=5, max_bin=32, local=local)).trees


@pytest.mark.parametrize("kind", ["tree", "histogram", "mae", "bagging", "boosting", "newton", "leafwise"])
def test_rows_without_a_finite_label_change_nothing_on_any_path(rows, spoilt, kind):
    wanted = [nodes(t) for t in trained(kind, rows, True)]
    for local in (True, False):
        got = [nodes(t) for t in trained(kind, spoilt, local)]
        assert got == wanted
    assert all(math.isfinite(x[4]) for t in wanted for x in t) and all(len(t) > 1 for t in wanted)


def test_no_labels_at_all(spark):
    empty = spark.createDataFrame([(1, 1.0, 2.0, None)], SCHEMA)
    for kind in ("tree", "newton", "leafwise", "bagging"):
        assert all(len(t) == 1 for t in trained(kind, empty, True) + trained(kind, empty, False))


@pytest.mark.parametrize("values", [[float(k % 5) for k in range(900)], [10.0 ** (k % 61 - 30) * (-1) ** k for k in range(900)], [random.Random(3).random() for _ in range(900)], [2.5]])
def test_selection_without_a_sort(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "row_id bigint, x double").repartition(3).cache()
    for k in {1, -(-len(values) // 3), len(values)}:
        for few in (3, 10_000):
            cut = sorted(values)[k - 1]
            assert sampling.kth(df, F.col("x"), k, few) == (cut, sum(v < cut for v in values), values.count(cut))
        chosen = df.where(sampling.first_rows(df, F.col("x"), "row_id", k))
        assert sorted(r["row_id"] for r in chosen.collect()) == sorted(i for _, i in sorted((v, i) for i, v in enumerate(values))[:k])
        assert "rangepartitioning" not in chosen._jdf.queryExecution().toString()


@pytest.mark.parametrize("config", [{}, {"max_depth": 2}, {"use_goss": False, "lam": 3.0}, {"top_rate": 0.4, "min_gain": 0.05}, {"finder": "histogram_eq:16"}])
def test_leaf_wise_over_the_cluster_equals_one_task(rows, config):
    c = leafwise.LeafwiseConfig(rounds=3, leaves=7, max_bin=40, min_data=5, **config)
    a = leafwise.train(rows, FEATURES, "label", "row_id", c)
    b = leafwise.train(rows, FEATURES, "label", "row_id", dataclasses.replace(c, local=False))
    assert [nodes(t) for t in a.trees] == [nodes(t) for t in b.trees]
    assert [h["train_loss"] for h in a.history] == pytest.approx([h["train_loss"] for h in b.history])


def test_a_pool_that_holds_few_leaves_grows_the_same_tree(rows, monkeypatch):
    from coppice.plans import pool

    c = leafwise.LeafwiseConfig(rounds=1, leaves=12, max_bin=40, min_data=5, use_goss=False)
    a = leafwise.train(rows, FEATURES, "label", "row_id", c)
    monkeypatch.setattr(pool, "CELLS", 4 * 80 * 2)
    b = leafwise.train(rows, FEATURES, "label", "row_id", dataclasses.replace(c, local=False))
    assert [nodes(t) for t in a.trees] == [nodes(t) for t in b.trees]


@pytest.mark.parametrize("edges", [[k * 0.1 for k in range(1, 256)], [1.0, 2.0, 4.0], [float(k * k) for k in range(200)], [5.0], [], [0.1 + 0.2 * k for k in range(20)]])
def test_bins_by_any_way_are_the_first_edge_at_or_above(spark, edges):
    values = [*edges, *(x + 1e-9 for x in edges), *(x - 1e-9 for x in edges), -1e300, 1e300, 0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["b"] for r in df.select("x", binning.bin_of(F.col("x"), edges).alias("b")).collect()]
    last = max(0, len(edges) - 1)
    assert got == [last if v is None else min([k for k, e in enumerate(edges) if e >= v], default=last) for v in values]


def test_the_median_criterion_gathers_no_group(rows):
    plan = criteria.node_metric(rows.withColumn("k", F.lit(1)), ["k"], "label", "mae")
    ys = sorted(r[3] for r in data())
    middle = (ys[199] + ys[200]) / 2
    assert plan.first()["metric"] == pytest.approx(sum(abs(y - middle) for y in ys) / len(ys))
    assert "median" not in plan._jdf.queryExecution().toString()


def test_searches_of_many_rows_use_no_window_by_feature(rows, monkeypatch):
    s = Search(features=FEATURES, finder="exhaustive")
    few = splits.best_splits(rows.withColumn("node_id", F.lit(0)), s).first()
    monkeypatch.setattr(splits, "MANY_VALUES", 10)
    many = splits.best_splits(rows.withColumn("node_id", F.lit(0)), s)
    assert tuple(many.first())[:4] == pytest.approx(tuple(few)[:4])
    assert "_part" in many._jdf.queryExecution().toString()


def test_dart_by_contributions(rows):
    """Left-out trees are arithmetic on the rows' leaf values; the history is that of scoring all trees anew."""
    c = boosting.BoostingConfig(rounds=4, max_depth=2, dart=True, drop_rate=0.4, normalise="original")
    made = boosting.train(rows, FEATURES, "label", "row_id", c)
    assert any(h["n_dropped"] for h in made.history)
    direct = boosting.evaluate(made, rows, "label", c).first()["mse"]
    scored = made.score(rows)
    assert scored.agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0] == pytest.approx(direct)


def there(df):
    return os.path.isdir(df._stored_path.removeprefix("file:")) if df._stored_path else df.storageLevel.useMemory


def test_scopes_free_what_they_store(rows):
    with store.scope():
        kept = store.stored(rows.select("row_id"))
        assert there(kept) and kept.count() == 400
    assert not there(kept)
    outer = store.stored(rows.select("f0"))
    assert there(outer)
    store.free(outer)
    assert not there(outer)


def test_training_leaves_no_tables(spark, tmp_path):
    """With a checkpoint folder, tables go there and are deleted again."""
    import subprocess
    import sys

    code = f"""
import os, sys
sys.path.insert(0, {str(__import__('os').path.dirname(__import__('os').path.dirname(__file__)))!r})
from pyspark.sql import SparkSession, functions as F
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
s.sparkContext.setCheckpointDir({str(tmp_path)!r})
from coppice.plans import leafwise, newton, grow
rows = s.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 17).cast("double").alias("f0"), (F.col("id") % 5).cast("double").alias("f1"), ((F.col("id") * 7) % 23).cast("double").alias("label"))
leafwise.train(rows, ["f0", "f1"], "label", "row_id", leafwise.LeafwiseConfig(rounds=6, leaves=4, max_bin=8, local=False))
newton.train(rows, ["f0", "f1"], "label", "row_id", newton.NewtonConfig(rounds=6, max_depth=2, subsample=0.5, local=False))
left = [f for d, _, fs in os.walk({str(tmp_path)!r}) for f in fs if f.endswith(".parquet")]
print("LEFT", len(left))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "LEFT 0" in out.stdout, out.stderr[-2000:]


def test_batches_of_a_csv(spark, tmp_path):
    lines = ["a,b"] + [f"{k},{k * 0.5}" for k in range(1000)]
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    reader = matrix_csv.BatchReader(spark, str(tmp_path / "x.csv"), str(tmp_path / "store"))
    assert reader.rows == 1000
    got = reader.batch(30, 485)
    assert sorted((r["rn"], r["a"]) for r in got.collect()) == [(k + 1, float(k)) for k in range(485, 515)]
    assert reader.batch(10, 995).count() == 5 and reader.batch(10, 1000).count() == 0
    assert "PushedFilters: [IsNotNull(rn)" in got._jdf.queryExecution().toString()


def test_ensembles_of_one_search_share_bins(rows):
    s = splits.with_edges(rows, Search(features=FEATURES, finder="histogram_ew:8"))
    ready = binning.binned(rows, FEATURES, s.edges, rows.columns)
    a = grow.level_wise(ready, dataclasses.replace(s, binned=True), grow.Growth(3, 5))
    b = grow.level_wise(rows, s, grow.Growth(3, 5))
    assert nodes(a) == nodes(b) and model.leaves(a) > 2


@pytest.mark.parametrize("kind", ["boosting", "newton"])
def test_ranks_made_once_grow_the_trees_of_values(spark, kind, monkeypatch):
    """With gaps in the features: an exhaustive search on ranks finds the same thresholds."""
    gaps = spark.createDataFrame([(k, None if k % 7 == 0 else a, math.nan if k % 11 == 0 else b, y) for k, a, b, y in data()], SCHEMA)
    by_rank = [nodes(t) for t in trained(kind, gaps, False)]
    wanted = [nodes(t) for t in trained(kind, gaps, True)]
    module = boosting if kind == "boosting" else newton
    monkeypatch.setattr(module, "ranked_values", lambda rows, s: s)
    assert by_rank == wanted == [nodes(t) for t in trained(kind, gaps, False)]


def test_conflicts_of_many_sparse_features(spark):
    from coppice.operators import bundling

    r = random.Random(5)
    names = [f"x{k}" for k in range(40)]
    table = [[int(r.random() < (0.6 if k == 0 else 0.05)) for k in range(40)] for _ in range(300)]
    df = spark.createDataFrame([tuple(x) for x in table], ", ".join(f"{n} int" for n in names))
    got = {(x["a"], x["b"]): (x["both"], x["either"]) for x in bundling.conflicts(df, names).collect()}
    want = {(a, b): (sum(x[a] and x[b] for x in table), sum(x[a] or x[b] for x in table)) for a in range(40) for b in range(a + 1, 40)}
    assert got == want
    found = bundling.bundles(df, names, 0.0, 255)
    assert sorted(f for b in found for f in b.features) == list(range(40)) and (0,) in [b.features for b in found]
    assert all(want[min(p, q), max(p, q)][0] == 0 for b in found for p in b.features for q in b.features if p != q)
    assert bundling.conflicts(df.select("x0"), ["x0"]).count() == 0


def test_a_directory_is_cleaned_in_one_write_a_header(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(6):
        head = "a,b" if k < 5 else "a,b,c"
        rows = [",".join(["1.0"] * (head.count(",")) + [str(100.0 * k if i else 1e6)]) for i in range(40)]
        (folder / f"m {k}.csv").write_text("\n".join([head, *rows]) + "\n")
    (folder / "empty.csv").write_text("a,b\n")
    names = matrix_csv.clean_directory(spark, str(folder), str(tmp_path / "out"), 3.0)
    assert names == ["empty.csv", *(f"m {k}.csv" for k in range(6))]
    for k in range(6):
        got = spark.read.csv(str(tmp_path / "out" / f"cleaned_m {k}.csv"), header=True)
        assert got.columns == ["a", "b", "c"][: 2 if k < 5 else 3] and {float(r[-1]) for r in got.collect()} == {100.0 * k} and got.count() == 39
    assert not [x for x in os.listdir(tmp_path / "out") if x.startswith(".cleaning")]


def test_workers_of_a_bag(rows):
    made, _ = bagging.train(rows, FEATURES, "label", "row_id", bagging.BaggingConfig(trees=5, max_depth=3))
    report = bagging.worker_report(made, 2)
    assert [(r["worker"], r["trees"], r["first"], r["draws"]) for r in report] == [(0, 3, 0, 1200), (1, 2, 3, 800)]
    assert all(r["seconds"] > 0 for r in report)


def test_large_tables_of_a_fit_are_held_on_disk(rows, monkeypatch):
    """Beyond SCATTERED_ROWS the rows of a fit take no memory from sorts and sums; the trees are the same."""
    config = bagging.BaggingConfig(trees=2, max_depth=3, local=False)
    small, _ = bagging.train(rows, FEATURES, "label", "row_id", config)
    levels, kind = [], type(rows)
    persist = kind.persist
    monkeypatch.setattr(grow, "SCATTERED_ROWS", 100)
    monkeypatch.setattr(kind, "persist", lambda df, *level: levels.append(level) or persist(df, *level))
    large, _ = bagging.train(rows, FEATURES, "label", "row_id", config)
    held = [x[0] for x in levels if x]
    assert len(held) >= 3 and not any(x.useMemory for x in held)
    for a, b in zip(small.trees, large.trees, strict=True):
        assert [(n.feature, n.threshold, n.samples) for n in a.values()] == [(n.feature, n.threshold, n.samples) for n in b.values()]
