import hashlib
import random

import numpy as np
import pytest

from coppice.llm import induced, suffix_dedup
from brute import removed_bytes


def brute_suffixes(data):
    b = bytes(data)
    order = sorted(range(len(b)), key=lambda i: b[i : i + induced.DEPTH], reverse=True)
    return [b[i : i + induced.DEPTH] for i in order]


@pytest.mark.parametrize("chunk,memory", [(1 << 20, 1 << 23), (7, 20)])
def test_suffixes_are_sorted_with_common_prefixes(monkeypatch, chunk, memory):
    monkeypatch.setattr(induced, "CHUNK", chunk)
    r = random.Random(3)
    for _ in range(150):
        symbols = r.choice([[97], [0, 255], [97, 98, 99], list(range(256))])
        data = [r.choice(symbols) for _ in range(r.randint(1, 90))]
        data = np.array(data + data[: r.randint(0, len(data))], np.uint8)
        got = list(induced.suffixes(data, in_memory=memory))
        pos, lcp = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
        assert sorted(pos.tolist()) == list(range(len(data)))
        texts = [bytes(data[i : i + induced.DEPTH]) for i in pos.tolist()]
        assert texts == brute_suffixes(data)
        for a, b, n in zip(texts, texts[1:], lcp[1:].tolist()):
            assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_no_data():
    assert list(induced.suffixes(np.zeros(0, np.uint8))) == []


def check(rows, docs):
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    want = sorted((str(i), len(t), n, s, hashlib.sha256(left).hexdigest()) for i, t, n, s, left in removed_bytes(texts))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == want


@pytest.mark.parametrize("block,shard", [(24 << 20, 6 << 20), (20_000, 20_000)])
def test_odd_documents(odd_docs, monkeypatch, block, shard):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    check(suffix_dedup.suffix_dedup(odd_docs).collect(), odd_docs)


def test_empty_table(no_docs):
    assert suffix_dedup.suffix_dedup(no_docs).collect() == []


def test_rest_is_given_back(odd_docs):
    for r in suffix_dedup.suffix_dedup(odd_docs, True).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]


def test_long_run_of_one_character(spark, monkeypatch):
    """Every place of a run is an anchor; they are laid out in parts."""
    monkeypatch.setattr(suffix_dedup, "ANCHORS_AT_ONCE", 1000)
    docs = spark.createDataFrame([(1, "x" * 20_000), (2, "y" + "x" * 30_000 + "z"), (3, "ab" * 9000)], "doc_id bigint, text string")
    check(suffix_dedup.suffix_dedup(docs).collect(), docs)


def test_wide_positions(monkeypatch):
    """What shards of 2^31 bytes and more use."""
    monkeypatch.setattr(induced, "MOST_SHORT", 0)
    monkeypatch.setattr(induced, "CHUNK", 11)
    r = random.Random(4)
    data = np.array([r.choice([97, 98]) for _ in range(300)], np.uint8)
    got = list(induced.suffixes(data, in_memory=30))
    assert all(x[0].dtype == np.int64 for x in got)
    assert [bytes(data[i : i + induced.DEPTH]) for x in got for i in x[0].tolist()] == brute_suffixes(data)


def test_long_seeds_are_named_no_further_than_order_is_asked_for(monkeypatch):
    """Seeds whose substrings agree for thousands of places: a bounded number of rounds, and still every run of equal strings."""
    data = np.frombuffer(b"".join(b"ab" + b"z" * 3000 + b"y" * 60 + bytes([97 + k]) for k in range(4)) * 2, np.uint8)
    rounds, regrouped = [], induced.regrouped
    monkeypatch.setattr(induced, "regrouped", lambda *a: rounds.append(1) or regrouped(*a))
    last, seen = None, 0
    whole = data.tobytes()
    for pos, lcp in induced.suffixes(data):
        for p, x in zip(pos.tolist(), lcp.tolist(), strict=True):
            now = whole[p : p + induced.DEPTH]
            if last is not None:
                assert now <= last and x == next((i for i, (a, b) in enumerate(zip(now, last)) if a != b), min(len(now), len(last)))
            last, seen = now, seen + 1
    assert seen == len(data)
    assert len(rounds) <= 14
