"""Tables that are computed once, and freed when nothing reads them any more.

Where there is a checkpoint folder they are written there, so that a lost executor costs no more than a read; else they are
held in memory. What is stored inside a scope is freed at its end: trainers open one a round, as their models do not read
tables. Outside of a scope a table stays for as long as the folder does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[DataFrame]] = []


def folder(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if at := folder(spark):
        path = f"{at.rstrip('/')}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        out._stored_path = path
    else:
        out = df.persist()
        out._stored_path = None
    if _scopes:
        _scopes[-1].append(out)
    return out


def free(*tables: DataFrame | None) -> None:
    for df in tables:
        if df is None:
            continue
        if path := getattr(df, "_stored_path", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        else:
            df.unpersist()


@contextmanager
def scope() -> Iterator[None]:
    """Frees at the end what stored() made inside, except in scopes of their own, which do so themselves."""
    _scopes.append([])
    try:
        yield
    finally:
        free(*_scopes.pop())


class Rolling:
    """A table that every round replaces by one made from it; the one before is freed once the new one has been computed."""

    def __init__(self, df: DataFrame):
        self.now, self.older = df.persist(), []

    def settled(self) -> None:
        """To be called after a job that has read all of now."""
        free(*self.older)
        self.older = []

    def replace(self, df: DataFrame, cut: bool) -> None:
        """cut: store the table, so that its lineage ends there."""
        self.older.append(self.now)
        self.now = stored(df) if cut else df.persist()

    def close(self) -> None:
        free(self.now, *self.older)
