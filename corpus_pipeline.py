"""A training corpus from raw documents: five stages, each on all that the one before kept.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns of any name;
all but the last return the columns they were given. What each makes of odd rows is said with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.common import discard, fresh, materialise, table
from coppice.llm.mixing import mixed
from coppice.llm.pieces import encode_documents, read_model
from coppice.llm.pii import sanitise
from coppice.llm.quality_model import THRESHOLD, fit, score_quality
from coppice.llm.simhash import without_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts are scored like others (as one chunk of
    padding), repeated rows alike; without labels of both kinds all scores are the prior."""
    net = fit(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "score")
    return score_quality(docs, net, tuple(docs.columns), name).where(F.col(name) >= THRESHOLD).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8): the one with the smallest doc_id, rows
    without one last; of repeated rows one. Null and empty texts are copies of each other."""
    return without_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, replaced in every text. Null texts stay null, empty ones empty; every row
    stays, repeated rows as rows of their own."""
    return sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that tokens come by source, language and topic in the target shares; some come more than once. Null
    sources and languages are levels of their own; rows with equal doc_id are drawn alike, rows without one each by itself;
    texts without words take the weight of their cell."""
    drawn = mixed(docs).where("_sampled")
    return drawn.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, beside doc_id, lang and source where the table has them. Null and empty texts have no pieces."""
    return encode_documents(docs, read_model(), tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", deduplicate),
    ("private", private),
    ("mix", mix),
    ("encode", encode),
]

#: SQL can express neither the classifier nor the encoder; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, on the documents of sf_dir, each written to the shared folder and read by the next; an
    empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
