"""Every query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from coppice import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Long iterations have tests of their own.
SLOW = {"leafwise_train", "newton_train_curve", "gbrt_train_curve", "gbrt_line_search_curve", "dart_train"}


def plain(rows):
    return sorted(repr(tuple(None if x is None or x != x else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - SLOW))
def test_query(spark, sf_dir, con, name):
    df = catalogue.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is not None:
        want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql}) q").fetchall()
        assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
