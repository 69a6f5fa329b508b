"""What the operators share: reading tables, the shared folder, Arrow batches of texts."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: the executors need a shared folder")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again; cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """Bytes of all texts: one aggregate, used to size partitions."""
    return docs.agg(F.sum(F.octet_length(col))).first()[0] or 0


def blocks_for(n_bytes: int, block_bytes: int, least: int = 1) -> int:
    return max(least, math.ceil(n_bytes / block_bytes))


def first_rows_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows at most, the same ones at every run: those of the smallest hashes of key."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.col(key)).limit(n)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is made of one stays small too."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def texts(batch: pa.RecordBatch, col: str = "text") -> Iterator[bytes]:
    """UTF-8 of each text; null is empty."""
    for x in batch.column(col).cast(pa.large_binary()):
        yield x.as_py() or b""


def crc_held_out(col: str = "doc_id") -> Column:
    """True on the fifth of the rows from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 5 == 0, F.lit(False))


def sorted_labels(labels: DataFrame, value: str) -> DataFrame:
    """(doc_id, value), a row a document, without nulls; the larger value where rows disagree."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull()).groupBy("doc_id").agg(F.max(value).alias(value))


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores before it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
