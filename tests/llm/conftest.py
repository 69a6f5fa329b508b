import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, score string, kept string, _row string, _body string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions under pale moonlight near old stone bridges".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) for _ in range(n))


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None, "x", "y", "z", "r", "b")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    base, long = prose(120, 1), prose(30_000, 2)
    rows = [row(1, base), row(2, base), row(3, base.replace("quick", "slow", 1)), row(4, None), row(5, ""), row(6, " \t\n "), row(7, "word"), row(8, long), row(9, "é漢字😀 \x00 ▁ ab  cd"), row(None, prose(60, 3)), row(10, "x" * 5000), row(11, "x" * 300, None, None), row(2, base), row(12, prose(80, 4), None, "s"), row(13, "mail me at jo.doe@mail.example.com or +1 (377) 555-0271 today")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (4, 0, 0), (None, 1, 1), (5, None, None), (10, 0, 0), (1, 0, 0), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
