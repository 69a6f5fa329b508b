import random
import zlib

import numpy as np
import pytest

from coppice.llm import quality_model, quality_rules
from coppice.llm.common import crc_held_out, table
from brute import quality_base


def test_rules_base_columns(odd_docs, odd_labels):
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.quality_rules(odd_docs, odd_labels).collect()}
    for d in odd_docs.collect():
        text = d["text"] or ""
        if len(text) > 10_000:
            continue
        n, chars, symbols, dup, rep, failed = quality_base(text)
        r = got[d["doc_id"], n]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (chars, symbols, dup, rep, failed)
        assert not (failed and r["kept"])


@pytest.mark.parametrize("text", ["a b c d e a b c d e x", "# one\n# one\n\n| two", "", "  x y", "a " * 40])
def test_statistics(text):
    assert quality_rules.statistics(text.encode())[:5] == quality_base(text)[:5]


def test_distinct_words_of_the_whole_text():
    rng = np.random.default_rng(4)
    for n, kinds in ((0, 1), (1, 1), (199, 50), (200, 50), (201, 50), (700, 90)):
        words = [b"%d" % x for x in rng.integers(0, kinds, n)]
        spans = [words[i : i + 200] for i in range(max(1, n - 199))]
        want = np.mean([len(set(w)) / max(1, len(w)) for w in spans])
        assert abs(quality_rules.statistics(b" ".join(words))[-1] - want) < 1e-12
    head = [b"w%d" % i for i in range(200)]
    spam = [b"s%d" % x for x in rng.integers(0, 9, 4000)]
    assert quality_rules.statistics(b" ".join(head + spam))[-1] < 0.2 and quality_rules.statistics(b" ".join(spam + head))[-1] < 0.2


def test_rules_empty_tables(no_docs, odd_docs, odd_labels):
    assert quality_rules.quality_rules(no_docs, odd_labels).collect() == []
    rows = quality_rules.quality_rules(odd_docs, odd_labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    score = quality_rules.IsolationForest(rows).score(rows)
    assert score.argmax() == 500 and 0 < score.min() and score.max() < 1


def test_chunks_cover_every_window():
    for n in (0, 1, 511, 512, 513, 2000):
        raw = (np.arange(n) % 251 + 1).astype(np.uint8)
        m = quality_model.chunk_matrix(raw)
        assert len(m) == quality_model.n_chunks(n)
        assert bytes(np.concatenate([c[: quality_model.CHUNK] for c in m])[:n]) == bytes(raw)


def test_network_learns_and_gradients_are_right():
    rng = np.random.default_rng(1)
    docs = [quality_model.chunk_matrix(np.frombuffer((b"good text here " if k % 2 else b"b#d*t%xt|h&re$ ") * 20, np.uint8)) for k in range(40)]
    truth = np.array([k % 2 for k in range(40)], np.float32)
    net = quality_model.train(docs, truth, epochs=8)
    tables = net.pair_tables()
    assert net.score(b"good text here " * 90, tables) > 0.7 > 0.3 > net.score(b"b#d*t%xt|h&re$ " * 90, tables)
    net = quality_model.ByteConvNet(rng)
    loss = lambda: float(np.mean([-np.log(p if t else 1 - p) for p, t in ((quality_model.sigmoid(net.logits(h.mean(0), h.max(0))), t) for h, t in ((net.pooled(d, net.pair_tables()), t) for d, t in zip(docs[:6], truth[:6])))]))
    grads = net.gradients(docs[:6], truth[:6])
    for part, g in zip(net.parts(), grads):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, eps = part[k], 1e-2
        part[k] = was + eps
        up = loss()
        part[k] = was - eps
        down = loss()
        part[k] = was
        assert abs((up - down) / (2 * eps) - g[k]) < 0.05 * abs(g[k]) + 1e-3


def test_model_on_odd_documents(odd_docs, no_docs, odd_labels):
    net = quality_model.fit(odd_docs, odd_labels)
    rows = quality_model.score_quality(odd_docs, net, tuple(odd_docs.columns), "_score").collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["_score"] <= 1 for r in rows)
    assert quality_model.score_quality(no_docs, net).collect() == []
    assert quality_model.fit(no_docs, odd_labels.limit(0)).score(b"", net.pair_tables()) == pytest.approx(0.5)


def naive_score(net, text):
    """The network by its definition: every window of WIDTH bytes of every chunk."""
    raw = list(text) + [0] * (quality_model.CHUNK + quality_model.WIDTH)
    pooled = []
    for k in range(max(1, -(-len(text) // quality_model.CHUNK))):
        best = np.full(quality_model.FILTERS, -np.inf)
        for i in range(k * quality_model.CHUNK, (k + 1) * quality_model.CHUNK):
            window = [raw[i + w] if i + w < len(text) else 0 for w in range(quality_model.WIDTH)]
            best = np.maximum(best, sum(net.embedding[window[w]] @ net.filters[w] for w in range(quality_model.WIDTH)))
        pooled.append(np.maximum(best + net.bias, 0))
    h = np.array(pooled)
    return 1 / (1 + np.exp(-(np.concatenate([h.mean(0), h.max(0)]) @ net.out + net.prior[0])))


@pytest.mark.parametrize("text", [b"", b"short one", bytes(range(256)) * 5])
def test_scores_equal_a_naive_network(text):
    net = quality_model.ByteConvNet(np.random.default_rng(3))
    assert net.score(text, net.pair_tables()) == pytest.approx(float(naive_score(net, text)), abs=1e-4)


def test_held_out_accuracy(spark):
    """On rows that training never saw, long texts too, whose junk stands anywhere in them."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    net = quality_model.fit(docs, labels)
    known = quality_model.score_quality(docs, net).join(labels.where(crc_held_out()), "doc_id").select("score", "quality").toPandas()
    right = (known["score"] >= quality_model.THRESHOLD) == (known["quality"] == 1)
    assert len(known) >= 50 and right.mean() >= 0.9


def test_training_reads_whole_texts_of_bounded_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"{k} " * 2000) for k in range(1, 40)] * 3, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id bigint, quality int")
    sample = quality_model.training_sample(docs, labels)
    assert sample["doc_id"].is_unique and (sample["text"].str.len() >= 4000).all() and not any(zlib.crc32(str(x).encode()) % 5 == 0 for x in sample["doc_id"])
    monkeypatch.setattr(quality_model, "TRAIN_BYTES", 30_000)
    assert 0 < sum(map(len, quality_model.training_sample(docs, labels)["text"])) <= 30_000


def test_threshold_looks_at_both_labels():
    scores, good = np.array([0.3, 0.31, 0.32, 0.35, 0.5, 0.6, 0.9]), np.array([1, 1, 1, 0, 1, 0, 0], bool)
    t = quality_rules.calibrate(scores, good, 0.0)
    assert t == pytest.approx(0.55)
    assert quality_rules.calibrate(scores, good, 0.25) == pytest.approx(0.335)
    assert quality_rules.calibrate(np.array([0.5, 0.4]), np.array([True, False])) == np.inf


def test_verdicts_on_odd_and_ordinary_documents(spark):
    """Ordinary prose stays, labelled or not; documents with a statistic far from all others go."""
    r = random.Random(2)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ra", "tu") for b in ("na", "vel", "dor", "sim", "pet")]
    prose = lambda: " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(150))
    odd = lambda: " ".join(r.choice(words).upper() + r.choice(["##", "$%", "|", "<>"]) for _ in range(150))
    rows = [(k, odd() if k % 20 == 0 else prose()) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 20 != 0)) for k in range(300)], "doc_id bigint, quality int")
    kept = {x["doc_id"]: x["kept"] for x in quality_rules.quality_rules(docs, labels).collect()}
    assert not any(kept[k] for k in range(0, 600, 20)) and sum(kept[k] for k in range(600) if k % 20) >= 565


def test_a_long_text_does_not_end_the_training_sample():
    assert quality_model.fitting(np.array([50, 200, 30, 0, 21, 20]), 100).tolist() == [True, False, True, True, False, True]
    assert not quality_model.fitting(np.array([101]), 100).any()


def test_threshold_of_a_table_is_that_of_its_rows(spark):
    rng = np.random.default_rng(7)
    for n, kinds in ((0, 2), (40, 1), (900, 2), (900, 900)):
        scores, good = np.round(rng.random(n) ** 2, 1 if kinds == 2 else 6), rng.random(n) < (0.8 if kinds > 1 else 2)
        scored = spark.createDataFrame([(int(g), float(x)) for g, x in zip(good, scores)], "quality int, anomaly double").repartition(3).cache()
        for loss in (0.0, 0.004, 0.3):
            assert quality_rules.calibrated(scored, loss) == pytest.approx(quality_rules.calibrate(scores, good, loss))


def test_all_labelled_rows_decide(spark, monkeypatch):
    """The only bad row that may go is among the last of the labels, whatever bound there once was."""
    monkeypatch.setattr(quality_rules, "LABELLED_ROWS", 5, raising=False)
    r = random.Random(5)
    prose = lambda: " ".join(r.choice(["kana", "lovel", "midor", "rasim", "tupet", "lona"]) + r.choice(["", "", "."]) for _ in range(80))
    docs = spark.createDataFrame([(k, "#%$ | " + " ".join(f"Q{j}#$" for j in range(90)) if k == 150 else prose()) for k in range(300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k != 150)) for k in range(300)], "doc_id bigint, quality int")
    kept = {x["doc_id"]: x["kept"] for x in quality_rules.quality_rules(docs, labels).where("not base_failed").collect()}
    assert kept[150] is False
