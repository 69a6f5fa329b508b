"""Lexical search against a plain count over all documents."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from coppice.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    """Sorted (item, rank, doc_id, score)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(Counter)
    for i, t in set(items):
        asked[i].update(terms(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for (i, c), n in zip(counts, sizes, strict=True):
            m = 75 + 25 * n * n_docs // max(1, n_terms)
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, x in wanted.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[:2], x[2] or 0))[:k])]
    return sorted(out, key=str)


def answer(spark, docs, items, **more):
    d = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in lexical.search(d, q, "doc_id", "item_id", **more).collect()), key=str)


WORDS = [a + b for a in "ka lo mi ra É 9 漢".split() for b in "na vel dor sim x7".split()]


@pytest.mark.parametrize("more", [{}, {"window": 64}, {"window": 70, "k": 3}, {"entries": 9}])
def test_scores_and_ranks(spark, more):
    r = random.Random(4)
    docs = [(r.randrange(5000), " ".join(r.choices(WORDS, range(1, len(WORDS) + 1), k=r.choice([0, 1, 5, 40, 300]))).replace("a", r.choice("aA"), 3)) for _ in range(600)]
    docs += [(9000 + k, "kana lovel, lovel") for k in range(60)]  # ties
    items = [(k, " ".join(r.choices(WORDS, k=12)) + "!") for k in range(12)] + [(20, "nowhere"), (21, "kana lovel"), (22, None), (3, "more kana"), (3, "more kana")]
    assert answer(spark, docs, items, **more) == plain(docs, items, more.get("k", 20))


def test_odd_rows(spark, odd_docs):
    docs = [(x["doc_id"], x["text"]) for x in odd_docs.select("doc_id", "text").collect()]
    items = [(1, "Quick FOX, seven wizards"), (None, "mail x"), (2, ""), (3, "ab cd 漢字 é 555"), (4, "x" * 300)]
    assert answer(spark, odd_docs, items) == plain(docs, items)


def test_a_long_text_in_pieces():
    text = ("Ab-c " * 500_000 + "x" * (3 << 20) + " é").encode()
    found = Counter(t for part in lexical.term_lists(text) for t in part)
    assert found == {b"ab": 500_000, b"c": 500_000, b"x" * (3 << 20): 1, "é".encode(): 1}


def test_nothing(spark, no_docs):
    assert answer(spark, no_docs, [(1, "a")]) == []
    assert answer(spark, [(1, "a")], []) == []
    assert answer(spark, [(1, "-"), (2, None)], [(1, "a")]) == []
