"""Learning matrices from the tables: row_id, features f0.., label (and node_id where a query groups rows).

Each has the SQL that states it, so that an oracle starts from the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Matrix:
    table: str
    sql: str
    features: tuple[str, ...]

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        name = f"coppice_{self.table}"
        spark.read.parquet(f"{sf_dir}/{self.table}.parquet").createOrReplaceTempView(name)
        return spark.sql(self.sql.format(t=name))

    @property
    def oracle(self) -> str:
        return self.sql.format(t=self.table)


#: Ordered splits, ntile, cleaning, sampling, boosting.
EVENTS = Matrix("events", "SELECT event_id AS row_id, CAST(user_id AS DOUBLE) AS f0, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS f1, CAST(event_id % 97 AS DOUBLE) AS f2, CAST(length(event_type) AS INTEGER) AS node_id, value AS label FROM {t}", ("f0", "f1", "f2"))
#: Order-free searches with few distinct values.
LINES = Matrix("lineitem", "SELECT l_quantity AS f0, l_discount AS f1, l_tax AS f2, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS node_id, l_extendedprice AS label FROM {t}", ("f0", "f1", "f2"))
#: Ties and small data.
PARTS = Matrix("part", "SELECT p_partkey AS row_id, CAST(p_size AS DOUBLE) AS f0, CAST(p_partkey % 13 AS DOUBLE) AS f1, 0 AS node_id, p_retailprice AS label FROM {t}", ("f0", "f1"))
#: Bagging and out-of-bag rows.
ORDERS = Matrix("orders", "SELECT o_orderkey AS row_id, CAST(o_custkey AS DOUBLE) AS f0, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS f1, CAST(o_orderkey % 31 AS DOUBLE) AS f2, 0 AS node_id, o_totalprice AS label FROM {t}", ("f0", "f1", "f2"))
