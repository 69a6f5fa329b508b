"""Numeric CSV matrices: scans, checks and sinks. The last column is the label unless one is named."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import finite
from ..operators.prep import within
from ..plans.ranking import numbered


def scan_matrix(spark: SparkSession, path: str, with_row_id: bool = False) -> DataFrame:
    """All columns as double; a cell that is no number is 0.0. with_row_id numbers the rows from 0 in file order: files by name, numbers in it as numbers."""
    raw = spark.read.csv(path, header=True)
    cells = [F.coalesce(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(0.0)).alias(c) for c in raw.columns if not (with_row_id and c == "row_id")]
    if not with_row_id:
        return raw.select(*cells)
    # Spark reads the largest files and splits first, so its own ids are in file order within a split only.
    at = raw.select(*cells, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    splits = at.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).collect()  # a row a split
    offsets, total = [], 0
    for r in sorted(splits, key=lambda r: (by_number(r["_file"]), r["_start"])):
        offsets.append((r["_file"], r["_start"], total - r["first"]))
        total += r["n"]
    table = spark.createDataFrame(offsets, "_file string, _start bigint, _more bigint")
    return at.join(F.broadcast(table), ["_file", "_start"]).select((F.col("_at") + F.col("_more")).alias("row_id"), *(c for c in raw.columns if c != "row_id"))


def by_number(name: str) -> list[str | int]:
    """A key by which part-100000 comes after part-99999."""
    return [int(x) if k % 2 else x for k, x in enumerate(re.split("([0-9]+)", name))]


class BatchReader:
    """Batches of a CSV file, or a folder of them, by position: it is scanned once into a table that is laid out by row number,
    so that a batch reads only the row groups it lies in, also where it crosses files. rows is how many there are."""

    def __init__(self, spark: SparkSession, path: str, store: str):
        scan_matrix(spark, path, True).withColumn("rn", F.col("row_id") + 1).drop("row_id").write.option("parquet.block.size", 1 << 20).parquet(store)
        self.table = spark.read.parquet(store)
        self.rows = self.table.count()

    def batch(self, size: int = 10_000, skip: int = 0) -> DataFrame:
        """size rows at most after the first skip, with rn, from 1; empty at the end of the file."""
        return self.table.where((F.col("rn") > skip) & (F.col("rn") <= skip + size))


def scan_batch(spark: SparkSession, path: str, batch: int = 10_000, skip: int = 0) -> DataFrame:
    """batch rows at most after the first skip; empty at the end of the file. For more than one batch see BatchReader."""
    rows = scan_matrix(spark, path, True)
    return rows.where((F.col("row_id") >= skip) & (F.col("row_id") < skip + batch)).orderBy("row_id").drop("row_id")


def scan_strict(spark: SparkSession, path: str) -> DataFrame:
    """All columns as double; a cell that is no number fails the read."""
    names = spark.read.csv(path, header=True).columns
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` double" for c in names), mode="FAILFAST")


def iterate(df: DataFrame) -> Iterator[Row]:
    """Rows one by one, a partition at a time."""
    return df.toLocalIterator(prefetchPartitions=False)


def file_stats(df: DataFrame) -> DataFrame:
    """One row: total_rows, total_features, estimated_memory_mb."""
    d = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select("total_rows", F.lit(d - 1).cast("bigint").alias("total_features"), (F.col("total_rows") * d * 8 / float(1 << 20)).alias("estimated_memory_mb"))


def validate(df: DataFrame, label: str) -> DataFrame:
    """One row: n_rows, n_bad (rows with a cell that is null or not finite), valid (there are labels)."""
    bad = F.lit(False)
    for c in df.columns:
        bad = bad | F.col(c).isNull() | ~finite(F.col(c).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad"), F.count(label).alias("_n")).select("n_rows", "n_bad", (F.col("_n") > 0).alias("valid"))


def write_results(df: DataFrame, column: str, path: str, order: str | None = None, one_file: bool = False) -> None:
    """A number a line, ten decimals."""
    ordered = df.orderBy(order) if order else df
    lines = ordered.select(F.format_string("%.10f", F.col(column)).alias("value"))
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header and rows at full precision."""
    df.write.mode("overwrite").csv(path, header=True)


def header_of(spark: SparkSession, fs, path) -> str:
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(path), "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def clean_directory(spark: SparkSession, folder: str, out: str, z: float = 3.0) -> list[str]:
    """Every CSV of a folder without rows whose last column lies beyond z; written to out/cleaned_<name>.

    All files of one header are one scan and one write, however many they are: statistics are grouped by file. A cell that
    is no number fails the read. Files without rows give no output.
    """
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(Path(folder)) if s.getPath().getName().endswith(".csv"))
    by_header: dict[str, list[str]] = {}
    for name in names:
        by_header.setdefault(header_of(spark, fs, Path(f"{folder}/{name}")), []).append(name)
    scratch, target = f"{out}/.cleaning-{uuid.uuid4().hex}", Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    for group, files in enumerate(by_header.values()):
        columns = scan_strict(spark, f"{folder}/{files[0]}").columns
        rows = spark.read.csv([f"{folder}/{name}" for name in files], header=True, schema=", ".join(f"`{c}` double" for c in columns), mode="FAILFAST")
        # The name stands in a URI there, so blanks and the like are escaped.
        numbers = spark.createDataFrame([(k, x) for k, name in enumerate(files) for x in {name, quote(name)}], "_f int, _name string")
        read = rows.select("*", F.col("_metadata.file_name").alias("_name")).join(F.broadcast(numbers), "_name")
        stats = read.groupBy("_f").agg(F.avg(columns[-1]).alias("_mean"), F.stddev_pop(columns[-1]).alias("_std"))  # a row a file
        kept = read.join(stats, "_f").where(within(F.col(columns[-1]), F.col("_mean"), F.col("_std"), z))
        kept.select(*columns, "_f").write.partitionBy("_f").csv(f"{scratch}/{group}", header=True)
        for k, name in enumerate(files):
            if target.exists(Path(f"{scratch}/{group}/_f={k}")):
                target.delete(Path(f"{out}/cleaned_{name}"), True)
                target.rename(Path(f"{scratch}/{group}/_f={k}"), Path(f"{out}/cleaned_{name}"))
    target.delete(Path(scratch), True)
    return names


def with_order(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Adds consecutive row ids to rows that have none, in the order they are stored in."""
    ranked = numbered(df.withColumn("_at", F.monotonically_increasing_id()), [F.col("_at")], name)
    return ranked.withColumn(name, F.col(name) - 1).drop("_at")
