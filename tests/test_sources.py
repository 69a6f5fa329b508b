import math
import os

import pytest
from pyspark.sql import functions as F

from coppice import cli
from coppice.operators import prep
from coppice.plans.ranking import numbered, running
from coppice.sources import matrix_csv
from coppice.streaming import score


@pytest.fixture()
def csv(tmp_path):
    path = tmp_path / "in" / "m.csv"
    path.parent.mkdir()
    lines = ["a,b,y"] + [f"{i},{i % 7},{2 * i + i % 7}" for i in range(60)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_scan_matrix(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,y\n1,2\nbad,3\n4,\n")
    assert sorted(tuple(r) for r in matrix_csv.scan_matrix(spark, str(path)).collect()) == [(0.0, 3.0), (1.0, 2.0), (4.0, 0.0)]
    with pytest.raises(Exception):
        matrix_csv.scan_strict(spark, str(path)).collect()


def test_batches_stats_and_validation(spark, csv):
    rows = matrix_csv.scan_matrix(spark, csv)
    assert [r["a"] for r in matrix_csv.scan_batch(spark, csv, 5, 10).collect()] == [10, 11, 12, 13, 14]
    assert matrix_csv.scan_batch(spark, csv, 5, 100).collect() == []
    stats = matrix_csv.file_stats(rows).first()
    assert (stats["total_rows"], stats["total_features"]) == (60, 2)
    assert tuple(matrix_csv.validate(rows, "y").first()) == (60, 0, True)
    assert matrix_csv.validate(rows.withColumn("y", F.when(F.col("a") == 3, math.inf).otherwise(F.col("y"))), "y").first()["n_bad"] == 1
    assert len(list(matrix_csv.iterate(rows))) == 60
    assert [r["row_id"] for r in matrix_csv.with_order(rows).orderBy("row_id").collect()] == list(range(60))


def test_sinks(spark, csv, tmp_path):
    rows = matrix_csv.scan_matrix(spark, csv)
    matrix_csv.write_results(rows, "y", str(tmp_path / "out"), "a", one_file=True)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[:2] == ["0.0000000000", "3.0000000000"] and len(lines) == 60
    assert matrix_csv.clean_directory(spark, os.path.dirname(csv), str(tmp_path / "clean"), 1.0) == ["m.csv"]
    assert 0 < spark.read.csv(str(tmp_path / "clean" / "cleaned_m.csv"), header=True).count() < 60


def test_splits_and_ranks(spark):
    rows = spark.range(101).select(F.col("id").alias("row_id"), (F.col("id") % 5).cast("double").alias("x")).repartition(7)
    assert sorted(r["rn"] for r in numbered(rows, [F.col("x"), F.col("row_id")]).collect()) == list(range(1, 102))
    train, test = prep.train_test(rows, "row_id")
    assert (train.count(), test.agg(F.min("row_id")).first()[0]) == (80, 80)
    assert [d.count() for d in prep.train_validation_test(rows, "row_id", 0.2)] == [70, 20, 11]
    head, tail = prep.validation_tail(rows, "row_id", 0.25)
    assert (head.count(), tail.count()) == (76, 25)
    sizes = [r["count"] for r in prep.equal_frequency_bins(rows, "x", 4, "row_id").groupBy("bin").count().orderBy("bin").collect()]
    assert sizes == [26, 25, 25, 25]
    assert numbered(rows.limit(0), [F.col("x")]).count() == 0


@pytest.mark.parametrize("argv", [["single", "--max-depth", "4"], ["single", "--pruner", "reduced_error", "--max-depth", "4"], ["bagging", "--trees", "3", "--max-depth", "4"], ["boosting", "--rounds", "2"], ["newton", "--rounds", "2", "--val-split", "0.2", "--patience", "1"], ["leafwise", "--rounds", "1", "--leaves", "4", "--min-data", "3", "--max-bin", "16"]])
def test_cli(spark, csv, argv):
    report = cli.run(spark, [argv[0], csv, *argv[1:]])
    assert report["trees"] >= 1 and report["test_mse"] >= 0


def test_stream(spark, csv, tmp_path):
    from coppice.plans import grow, model

    rows = matrix_csv.scan_matrix(spark, csv)
    made = model.Ensemble(["a", "b"])
    made.add(grow.train_tree(rows, ["a", "b"], "y", max_depth=3))
    stream = spark.readStream.schema(rows.schema).csv(os.path.dirname(csv), header=True).withColumn("ts", F.timestamp_seconds(F.col("a")))
    scored = score.score_stream(made, stream).withColumnRenamed("y", "label")
    query = score.windowed_error(scored, "ts", window="30 seconds").writeStream.format("memory").queryName("errors").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(r["n"] for r in spark.table("errors").collect()) == 60


def test_rows_of_a_folder_are_numbered_in_file_order(spark, tmp_path):
    """Files and splits of growing size: Spark reads the largest first, and part-100000 stands before part-2 as a text."""
    at, n, names = tmp_path / "m", 0, ["part-00001", "part-2", "part-100000"]
    at.mkdir()
    for name, size in zip(names, (10, 200, 3000)):
        (at / f"{name}.csv").write_text("a,y\n" + "".join(f"{k},{2 * k}\n" for k in range(n, n + size)))
        n += size
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = matrix_csv.scan_matrix(spark, str(at), True)
        assert sorted((r["row_id"], r["a"]) for r in rows.collect()) == [(k, float(k)) for k in range(n)]
        assert [r["a"] for r in matrix_csv.scan_batch(spark, str(at), 7, 205).collect()] == list(range(205, 212))
        reader = matrix_csv.BatchReader(spark, str(at), str(tmp_path / "batches"))
        assert reader.rows == n and sorted((r["rn"], r["a"]) for r in reader.batch(100, 150).collect()) == [(k + 1, float(k)) for k in range(150, 250)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_running_sums_send_no_table_to_the_driver(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"), F.lit(1).alias("c"))
    made = running(rows, ["g"], "v", ["c"], "v")
    assert {(r["c_c"], r["t_c"], r["nxt"]) for r in made.where("v in (7, 2998)").collect()} == {(3, 1000, 10), (1000, 1000, None)}
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_running_sums_pass_over_batches_without_a_window(spark):
    """Groups that go on over several batches and ranges, some values missing; large groups are held by no window."""
    n, spread = 3000, "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = [(None if k % 3 == 2 else float(k % 3), k, None if k < 9 or k % 5 == 0 else k / 8) for k in range(n)]
    spark.conf.set(spread, "64")
    try:
        made = running(spark.createDataFrame(given, "g double, v int, x double").repartition(5), ["g"], "v", ["x"], "v")
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["g"], r["v"]): r for r in made.collect()}
    finally:
        spark.conf.unset(spread)
    assert "lead" not in plan.replace("lead(_first", "")
    for g in (0.0, 1.0):
        mine, total = [(v, x) for k, v, x in given if k == g], None
        for i, (v, x) in enumerate(mine):
            total = total if x is None else x + (total or 0.0)
            r = got[g, v]
            assert r["c_x"] == total and r["nxt"] == (mine[i + 1][0] if i + 1 < len(mine) else None)
    # A group without a key joins nothing, as before.
    assert len(got) == 2000
