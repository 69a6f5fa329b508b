"""The manifest against a plain Merkle tree over lists."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from coppice.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(digests, fanout=3):
    """(root, proofs): for each leaf the (before, after) of every level."""
    proofs, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for leaf, k in enumerate(at):
            a = k - k % fanout
            proofs[leaf].append(("".join(digests[a:k]), "".join(digests[k + 1 : a + fanout])))
            at[leaf] = k // fanout
        digests = [sha("".join(digests[k : k + fanout])) for k in range(0, len(digests), fanout)]
    return digests[0], proofs


def plain(rows):
    """Sorted rows of op11 for (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    low = {g: climb([leaf(r) for r in groups[g]]) for g in names}
    root, high = climb([low[g][0] for g in names])
    out = []
    for g, above in zip(names, high, strict=True):
        for r, path in zip(groups[g], low[g][1], strict=True):
            whole = path + above
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            done = leaf((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))
            for before, after in whole:
                done = sha(before + done + after)
            out.append((r[0], leaf(r), low[g][0], root, sha("".join(b + a for b, a in whole)), done, done == root))
    return sorted(out, key=str)


def answer(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in merkle.op11_merkle(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [1, 1], [9, 1, 10], [28, 3, 1, 5]])
def test_runs_of_three(spark, tmp_path, sizes):
    rows = [(100 * g + k, f"s{g}", "en", None, f"line {k}\nmore {g}" if k % 4 else "one") for g, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = answer(spark, tmp_path, docs.repartition(3))
    assert got == plain(rows)
    assert any(not r[-1] for r in got) == any(zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in r[4] for r in rows)


def test_odd_rows(spark, tmp_path, odd_docs):
    wanted = [tuple(r) for r in odd_docs.select(*merkle.FIELDS).collect()]
    assert answer(spark, tmp_path, odd_docs) == plain(wanted)


def test_no_rows(spark, tmp_path, no_docs):
    assert answer(spark, tmp_path, no_docs) == []


def test_other_fanout_and_a_hot_row(spark):
    """Two thirds of the rows are one repeated row; every proof leads to the root, and no other digest does."""
    docs = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id")).alias("doc_id"), F.lit("s").alias("source"))
    made = merkle.manifest(docs.withColumn("digest", merkle.row_digest(doc_id=F.col("doc_id"), source=F.col("source"))), F.col("source"), ["doc_id"], fanout=5)
    proofs = made.proofs()
    wrong = merkle.digest(F.lit("x"))
    got = proofs.agg(F.count(F.lit(1)), F.count_distinct("pos"), F.sum((merkle.folded(F.col("digest"), F.col("proof")) == made.root).cast("int")), F.sum((merkle.folded(wrong, F.col("proof")) == made.root).cast("int"))).first()
    assert tuple(got) == (300, 300, 300, 0)
    assert made.root == climb([r["digest"].hex() for r in made.levels[0].orderBy("pos").collect()], 5)[0]
