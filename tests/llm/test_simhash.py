import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from coppice.llm import simhash
from brute import components


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="abC É\n\t", max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_forests_connect_what_links_connect():
    r = random.Random(5)
    for n in (2, 40, 300):
        centre = r.getrandbits(64)
        fps = list({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(n)} | {r.getrandbits(64) for _ in range(n)})
        want = components(fps, 4)
        for f in (simhash.forest, simhash.forest_between):
            got = f(np.array(fps, np.uint64), np.arange(len(fps)))
            label = list(range(len(fps)))
            assert len(got) <= len(fps) - 1
            for _ in range(len(fps)):
                for a, b in got:
                    label[a] = label[b] = min(label[a], label[b])
            assert label == want


def test_partitions_and_thresholds():
    both = np.full((64, 64), 25.0)
    np.fill_diagonal(both, 50)
    both[3, 60] = both[60, 3] = 50
    groups = simhash.partition_bits(100, both, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any({3, 60} <= set(g) for g in groups)
    hists = [np.zeros(1 << simhash.HIST_BITS) for _ in range(4)]
    for k, h in enumerate(hists):
        h[:: k + 1] = 1
    cost, chosen = simhash.thresholds(1000, [16] * 4, hists)
    assert sum(t + 1 for t in chosen) == simhash.DISTANCE + 1 and cost > 0


def test_candidate_counts_are_exact_on_whole_histograms():
    r = np.random.default_rng(1)
    hist = np.zeros(1 << simhash.HIST_BITS)
    at = r.integers(0, 1 << simhash.HIST_BITS, 30)
    np.add.at(hist, at, 1)
    for radius, got in enumerate(simhash.candidate_counts(hist, simhash.HIST_BITS, 2)):
        assert abs(got - sum(int(a ^ b).bit_count() <= radius for a in at for b in at)) < 1e-6


def test_odd_documents(odd_docs):
    rows = [r for r in simhash.near_duplicates(odd_docs).collect()]
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect() if r["doc_id"] is not None]
    fps = [brute_fingerprint(t) for _, t in texts]
    label = components(fps, 4)
    least = {}
    for k, (i, _) in zip(label, texts):
        least[k] = min(i, least.get(k, i))
    want = sorted((i, least[k]) for k, (i, _) in zip(label, texts))
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None) == want
    assert len(rows) == len(texts) + 1


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 200)] + [(300, 301)], "u bigint, v bigint")
    got = dict(simhash.components(edges).collect())
    assert all(got[k] == 1 for k in range(2, 201)) and got[301] == 300


def edited(words, share, r):
    out = list(words)
    for k in r.sample(range(len(out)), round(share * len(out))):
        out[k] = f"{out[k]}x{r.randrange(99)}"
    return " ".join(out)


def test_edited_copies_go_and_others_stay(spark):
    """Against exact similarities of all pairs: links of 0.8 and more are found, none below."""
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    docs = []
    for k in range(60):
        words = r.choices(vocabulary, k=r.randint(60, 700))
        docs.append(" ".join(words))
        docs += [edited(words, share, r) for share in r.choices((0.0, 0.004, 0.008, 0.015, 0.02, 0.04, 0.08), k=r.randint(0, 5))]
    r.shuffle(docs)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (d.split() for d in docs)]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if 0.7 < len(sets[i]) / len(sets[j]) < 1.4 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = list(range(len(docs)))
    for _ in range(8):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    want = {i for i in range(len(docs)) if label[i] == i}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = {x["doc_id"] for x in simhash.without_near_copies(df).collect()}
    assert want <= got and len(got - want) <= 0.05 * (len(docs) - len(want)) and len(docs) - len(want) > 50


def test_one_row_of_each_class_stays(spark, no_docs):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (2, "a b c", "z"), (None, "a b c", "u"), (None, "d e f", "v"), (None, "d e f", "w"), (5, None, "n"), (6, "", "e"), (7, "g h i", "s"), (7, "k l m", "t")]
    kept = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string, _key string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept if r["text"]) == [("1", "a b c"), ("7", "g h i"), ("7", "k l m"), ("None", "d e f")]
    assert [r["doc_id"] for r in kept if not r["text"]] == [5]
    assert simhash.without_near_copies(no_docs).collect() == []


def test_dense_and_flat_groups_agree():
    r = random.Random(7)
    base = r.getrandbits(64)
    fps = np.array([base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))) for _ in range(200)], np.uint64)
    own = np.arange(200) < 40
    flat = simhash.found_groups(own, fps, np.array([0, 200]), 4)
    dense = simhash.dense_groups(own, fps, 4, 0)
    assert sorted(map(list, flat)) == sorted(map(list, dense)) and flat
