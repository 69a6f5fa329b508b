import corpus_pipeline as cp
from pyspark.sql import functions as F

from coppice.llm import pii, simhash
from coppice.llm.common import table


def test_stages(spark, sf_dir, odd_docs):
    docs = table(spark, sf_dir, "documents")
    seen = [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, seen[-1], sf_dir)
        assert name == "encode" or out.columns == docs.columns
        seen.append(out.cache())
    counts = [d.count() for d in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] and counts[-1] > 0.5 * counts[0]
    labels = table(spark, sf_dir, "labels")
    kept = seen[1].join(labels, "doc_id")
    assert kept.where("quality = 1").count() >= 0.97 * docs.join(labels.where("quality = 1"), "doc_id").count()
    left = simhash.near_duplicates(seen[2])
    assert left.where("component_id <> doc_id").count() == 0
    assert pii.find_pii(seen[3]).where(F.size("_base") > 0).count() == 0
    assert seen[5].where("not round_trip").count() == 0


def test_stages_keep_odd_columns(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
