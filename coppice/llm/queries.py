"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lexical, licenses, merkle, rotation_codes, suffix_dedup, topk
from .html_extract import op4_html
from .lexical import op12_lexical
from .licenses import op2_licenses
from .merkle import op11_merkle
from .mixing import op6_mixing
from .pieces import op8_sentencepiece
from .pii import op10_pii
from .quality_model import op7_quality
from .quality_rules import op9_quality_rules
from .rotation_codes import op13_near_vectors
from .simhash import op3_simhash
from .suffix_dedup import op1_suffix_dedup
from .topk import op5_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_licenses": op2_licenses,
        "op3_simhash": op3_simhash,
        "op4_html": op4_html,
        "op5_topk": op5_topk,
        "op6_mixing": op6_mixing,
        "op7_quality": op7_quality,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_quality_rules": op9_quality_rules,
        "op10_pii": op10_pii,
        "op11_merkle": op11_merkle,
        "op12_lexical": op12_lexical,
        "op13_near_vectors": op13_near_vectors,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op2_licenses": licenses.oracle_sql(),
        "op5_topk": topk.ORACLE_SQL,
        "op11_merkle": merkle.ORACLE_SQL,
        "op12_lexical": lexical.ORACLE_SQL,
        "op13_near_vectors": rotation_codes.ORACLE_SQL,
    }
