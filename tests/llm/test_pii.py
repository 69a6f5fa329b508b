import hashlib

import pytest
from pyspark.sql import functions as F

from coppice.llm import pii
from brute import pii_spans

TEXTS = [
    "a@b.c", "x a.b_c@d-e.f.g. h@i", "@@a@b.c@d.e_f@g.h", "1.2.3.4 256.1.1.1.5 1.2.3.4.5.6.7.8 0001.02.3.0255", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111111", "+1 (377) 555-0271 +12345 +1234567890123456 +4 4", "é😀 jo@x.yz 漢 +49 30 1234567",
    "a@b.c" * 300, "7" * 4000, "a." * 3000, "+1(((((((((9" * 50, "", " ",
]


def spans(df):
    return {r["doc_id"]: r["s"] for r in pii.find_pii(df).select("doc_id", pii.span_string(F.col("_base")).alias("s")).collect()}


def test_base_spans(spark):
    got = spans(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string"))
    for i, t in enumerate(TEXTS):
        assert got[i] == ",".join(pii_spans(t)), t[:60]


def test_odd_documents_keep_their_rows(odd_docs, no_docs):
    found = pii.find_pii(odd_docs).collect()
    assert len(found) == odd_docs.count() and pii.find_pii(no_docs).collect() == []
    clean = pii.sanitise(odd_docs)
    assert clean.columns == odd_docs.columns
    before, after = ({(r["doc_id"], r["source"]): r["text"] for r in df.collect()} for df in (odd_docs, clean))
    changed = [k for k in before if before[k] != after[k]]
    assert changed == [(13, "s")] and after[13, "s"] == "mail me at [EMAIL] or [PHONE] today"
    assert after[4, "s"] is None and pii.sanitise(no_docs).collect() == []


def test_terms_that_reveal(spark):
    """A name that only stands beside one address goes; a common word beside it stays."""
    rows = [(i, f"report {i} {'q' * i}z please ask Zebulon at zeb@mail.example.org about things") for i in range(4)] + [(10 + i, f"please ask about things {'w' * i}") for i in range(60)]
    found = {r["doc_id"]: r["s"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", pii.span_string(F.col("_spans")).alias("s")).collect()}
    for i, text in rows[:4]:
        at = text.index("Zebulon")
        assert f"term:{at}:{at + 7}" in found[i] and f"term:{text.index('please')}:" not in found[i]
    assert all(found[i] == "" for i, _ in rows[4:])


def test_owner_of_an_address_in_one_document(spark):
    """One document is enough for the owner's name to go with the address; a common word beside it stays."""
    rows = [(0, "please ask Zebulon at zeb@mail.example.org about things")] + [(i, "please ask us at home about things") for i in range(1, 2000)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert clean.pop(0) == "please ask [TERM] at [EMAIL] about things"
    assert clean == dict(rows[1:])


def test_terms_anywhere_in_the_document(spark):
    """A short name far from the address goes at each of its places in documents with the address, and only there."""
    far = "we ask about things at home " * 40
    rows = [(i, f"Ann Lee\n{far}a@mail.example.org {far}So Lee, said Ann") for i in range(3)] + [(i, far) for i in range(3, 3000)] + [(3000, "home of Kim")]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i in range(3):
        assert clean[i].startswith("[TERM] [TERM]\nwe ask") and clean[i].endswith("[TERM] [TERM], [TERM] [TERM]") and clean[i].count("[TERM]") == 6
    assert all(clean[i] == t for i, t in rows[3:])


@pytest.mark.parametrize("spans_,want", [([], "abcdef"), ([("email", 0, 2)], "[EMAIL]cdef"), ([("card", 1, 4), ("phone", 3, 6)], "a[CARD]"), ([("ip", 4, 6), ("email", 0, 1)], "[EMAIL]bcd[IP]")])
def test_redaction(spark, spans_, want):
    df = spark.createDataFrame([("abcdef", [(k, a, z, "") for k, a, z in spans_])], "t string, s " + pii.SPAN)
    assert df.select(pii.redacted(F.col("t"), F.col("s"))).first()[0] == want


def test_digest_of_no_spans(odd_docs):
    got = odd_docs.sparkSession.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
    assert got == hashlib.sha256(b"").hexdigest()


def test_prefix_sums(spark):
    xs = list(range(1, 700))
    got = spark.createDataFrame([(xs,)], "x array<int>").select(pii.prefix_sums(F.col("x"))).first()[0]
    assert got == [sum(xs[: k + 1]) for k in range(len(xs))]
