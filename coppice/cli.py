"""python -m coppice.cli single|bagging|boosting|newton|leafwise|clean PATH [options]: train on a CSV, report errors and importances."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.criteria import evaluate
from .operators import prep
from .plans import bagging, boosting, grow, leafwise, model, newton
from .sources import matrix_csv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, **options) -> None:
        c = sub.add_parser(name)
        c.add_argument("path")
        for key, default in options.items():
            flag = "--" + key.replace("_", "-")
            if isinstance(default, bool):
                c.add_argument(flag, action=argparse.BooleanOptionalAction, default=default)
            else:
                c.add_argument(flag, type=type(default), default=default)

    command("single", max_depth=800, min_leaf=2, criterion="mse", finder="exhaustive", pruner="none", prune_param=0.01, val_split=0.2)
    command("bagging", trees=20, ratio=1.0, max_depth=10, min_leaf=2, criterion="mse", finder="exhaustive", pruner="none", prune_param=0.01, seed=42, workers=1)
    command("boosting", loss="squared", rounds=30, rate=0.1, max_depth=4, min_leaf=1, criterion="mse", finder="exhaustive", subsample=1.0, line_search=False, patience=0, dart=False, drop_rate=0.1, normalise="none", skip_drop_for_prediction=True, val_split=0.0, seed=42)
    command("newton", objective="reg:squarederror", rounds=30, eta=0.3, max_depth=6, min_child_weight=1.0, lam=1.0, gamma=0.0, alpha=0.0, subsample=1.0, colsample=1.0, approximate=False, max_bins=256, patience=0, val_split=0.0, seed=42)
    command("leafwise", rounds=100, rate=0.1, leaves=31, min_data=20, min_gain=0.0, max_depth=-1, lam=0.0, top_rate=0.2, other_rate=0.1, use_goss=True, max_bin=255, finder="", patience=0, val_split=0.0, seed=42)
    command("clean", out="data_clean", z=3.0)
    return p


def run(spark: SparkSession, argv: list[str]) -> dict:
    """The report as a dictionary."""
    args = vars(parser().parse_args(argv))
    command, path = args.pop("command"), args.pop("path")
    if command == "clean":
        return {"cleaned": matrix_csv.clean_directory(spark, path, args["out"], args["z"])}
    rows = matrix_csv.scan_matrix(spark, path, True)
    names = [c for c in rows.columns if c != "row_id"]
    features, label = names[:-1], names[-1]
    validation = None
    share = args.pop("val_split", 0.0)
    if command == "single" and args["pruner"] == "reduced_error":
        train, validation, test = prep.train_validation_test(rows, "row_id", share)
    else:
        train, test = prep.train_test(rows, "row_id")
        if command in ("boosting", "newton", "leafwise") and share > 0:
            train, validation = prep.validation_tail(train, "row_id", share)
    began, workers = time.time(), args.pop("workers", 1)
    if command == "single":
        made = model.Ensemble(features)
        made.add(grow.train_tree(train, features, label, validation=validation, **args))
    elif command == "bagging":
        made, _ = bagging.train(train, features, label, "row_id", bagging.BaggingConfig(**args))
    elif command == "boosting":
        config = boosting.BoostingConfig(**args)
        made = boosting.train(train, features, label, "row_id", config, validation)
    elif command == "newton":
        made = newton.train(train, features, label, "row_id", newton.NewtonConfig(**args), validation)
    else:
        made = leafwise.train(train, features, label, "row_id", leafwise.LeafwiseConfig(**args), validation)
    seconds = time.time() - began
    scored = boosting.predict(made, test, config) if command == "boosting" else made.score(test)
    errors = evaluate(scored.withColumn("label", F.col(label)), "label").first()
    top = model.top_importance(made.importance(spark, "samples" if command == "boosting" else "count")).collect()
    report = {"workers": (found := bagging.worker_report(made, workers)), "slowest_worker": max(found, key=lambda r: r["seconds"])} if command == "bagging" and workers > 1 else {}
    return report | {"command": command, "seconds": round(seconds, 3), "trees": len(made.trees), "test_mse": errors["mse"], "test_mae": errors["mae"], "importance": [(features[r["feature"]], r["importance"]) for r in top]}


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("coppice").getOrCreate()
    print(json.dumps(run(spark, sys.argv[1:])))


if __name__ == "__main__":
    main()
