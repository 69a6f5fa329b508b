"""Quality classifier: a byte-level convolutional network in numpy.

Every text is cut into overlapping chunks that cover all of its bytes. Learned filters run over the bytes of a chunk,
each chunk is max-pooled, the pooled chunks of a document are combined (mean and maximum) and a logistic layer makes one
probability of them. Training happens on the driver, on all chunks of a bounded sample of labelled rows (TRAIN_DOCS rows
and TRAIN_BYTES in all, in the order of a hash; one row of each doc_id); scoring is one map over the documents with the small weights in the closure, no shuffle.

Null and empty texts are one chunk of padding and get a score as well. Without labels of both kinds every score is the
prior. Only bytes are read: neither ids, labels, language nor source. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_held_out, discard, first_rows_by_hash, materialise, slices, sorted_labels, table, texts

EMBED, WIDTH, FILTERS = 6, 8, 16
#: Bytes a chunk advances; WIDTH - 1 more are read, so that each window of bytes lies in a chunk.
CHUNK = 512
#: Bounds of the training sample: labelled rows, and bytes of their whole texts.
TRAIN_DOCS, TRAIN_BYTES = 2400, 16 << 20
EPOCHS, BATCH, RATE, DECAY = 7, 32, 0.01, 1e-4
#: Steps at least, however small the sample.
LEAST_STEPS = 300
THRESHOLD = 0.3
#: Chunks scored at once, which bounds memory however long a text is.
AT_ONCE = 256
SEED = 7


def chunk_matrix(raw: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Chunks first..last-1 of a text, one a row of CHUNK + WIDTH - 1 bytes, padded with zero bytes."""
    n = n_chunks(len(raw))
    last = n if last is None else min(last, n)
    part = raw[first * CHUNK : last * CHUNK + WIDTH - 1]
    whole = np.zeros((last - first) * CHUNK + WIDTH - 1, np.uint8)
    whole[: len(part)] = part
    return np.lib.stride_tricks.sliding_window_view(whole, CHUNK + WIDTH - 1)[::CHUNK]


def n_chunks(n_bytes: int) -> int:
    return max(1, -(-n_bytes // CHUNK))


class ByteConvNet:
    """embedding [256, EMBED], filters [WIDTH, EMBED, FILTERS], bias, and the logistic layer over mean and maximum."""

    def __init__(self, rng: np.random.Generator | None = None, prior: float = 0.5):
        rng = rng or np.random.default_rng(SEED)
        self.embedding = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH, EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.prior = np.array([np.log(prior / (1 - prior))], np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.prior]

    def pair_tables(self) -> np.ndarray:
        """What each two neighbouring bytes add to every filter, for each pair of taps: [WIDTH / 2, 65536, FILTERS]."""
        taps = np.einsum("be,wef->wbf", self.embedding, self.filters)
        return (taps[1::2, :, None, :] + taps[0::2, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS)

    def pooled(self, chunks: np.ndarray, tables: np.ndarray, with_places: bool = False):
        """Largest response of each filter in each chunk, rectified; with the places if they are asked for."""
        pairs = chunks[:, :-1].astype(np.int32) | chunks[:, 1:].astype(np.int32) << 8
        total = tables[0][pairs[:, :CHUNK]]
        for k in range(1, WIDTH // 2):
            total += tables[k][pairs[:, 2 * k : 2 * k + CHUNK]]
        if not with_places:
            return np.maximum(total.max(1) + self.bias, 0)
        places = total.argmax(1)
        return np.take_along_axis(total, places[:, None], 1)[:, 0] + self.bias, places

    def logits(self, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.concatenate([mean, most], -1) @ self.out + self.prior[0]

    def score(self, text: bytes, tables: np.ndarray) -> float:
        """Probability of label 1, from all bytes of the text."""
        raw = np.frombuffer(text, np.uint8)
        n, total, most = n_chunks(len(raw)), np.zeros(FILTERS, np.float64), np.zeros(FILTERS, np.float32)
        for k in range(0, n, AT_ONCE):
            h = self.pooled(chunk_matrix(raw, k, k + AT_ONCE), tables)
            total += h.sum(0)
            most = np.maximum(most, h.max(0))
        return float(sigmoid(self.logits((total / n).astype(np.float32), most)))

    def gradients(self, docs: list[np.ndarray], truth: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss of a batch; docs: the chunks of each."""
        sizes = np.array([len(x) for x in docs])
        chunks, owner = np.concatenate(docs), np.repeat(np.arange(len(docs)), sizes)
        tables = self.pair_tables()
        raw, places = (np.concatenate(x) for x in zip(*(self.pooled(chunks[k : k + AT_ONCE], tables, True) for k in range(0, len(chunks), AT_ONCE)), strict=True))
        h = np.maximum(raw, 0)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean, most = np.add.reduceat(h, starts) / sizes[:, None], np.maximum.reduceat(h, starts)
        slope = ((sigmoid(self.logits(mean, most)) - truth) / len(docs)).astype(np.float32)
        g_out, g_prior = np.concatenate([mean, most], 1).T @ slope, slope.sum(keepdims=True)
        g_h = (slope[:, None] * self.out[:FILTERS] / sizes[:, None])[owner]
        is_most = h == most[owner]
        share = np.add.reduceat(is_most, starts).astype(np.float32)
        g_h += is_most * (slope[:, None] * self.out[FILTERS:] / share)[owner]
        g_h *= raw > 0
        g_filters, g_embedding = np.zeros_like(self.filters), np.zeros_like(self.embedding)
        rows = np.arange(len(chunks))[:, None]
        for w in range(WIDTH):
            seen = chunks[rows, places + w]  # [chunk, filter]
            g_filters[w] = np.einsum("cfe,cf->ef", self.embedding[seen], g_h)
            np.add.at(g_embedding, seen, g_h[:, :, None] * self.filters[w].T[None])
        return [g_embedding, g_filters, g_h.sum(0), g_out, g_prior]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(docs: list[np.ndarray], truth: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteConvNet:
    """Adam over batches of documents; docs: the chunks of each."""
    rng = np.random.default_rng(seed)
    if not len(truth) or truth.min() == truth.max():
        net = ByteConvNet(rng, float(np.clip(truth.mean() if len(truth) else 0.5, 0.01, 0.99)))
        net.out[:] = 0
        return net
    net = ByteConvNet(rng, float(truth.mean()))
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(docs)))
    one, two, t = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(docs))
        for k in range(0, len(docs), BATCH):
            at = order[k : k + BATCH]
            t += 1
            for p, g, a, b in zip(net.parts(), net.gradients([docs[i] for i in at], truth[at]), one, two, strict=True):
                g = g + DECAY * p
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)
    return net


def training_sample(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """(quality, text): whole texts of TRAIN_DOCS labelled rows at most that are not held out, those that have room in TRAIN_BYTES, one after another."""
    marked = first_rows_by_hash(sorted_labels(labels, "quality").where(~crc_held_out()), "doc_id", TRAIN_DOCS)
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id")  # TRAIN_DOCS rows of two integers at most
    one = stored = materialise(joined.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text")))
    order = first_rows_by_hash(one.select("doc_id", F.octet_length("text").alias("size")), "doc_id", TRAIN_DOCS).toPandas()
    chosen = order[fitting(order["size"].to_numpy(), TRAIN_BYTES)]
    if len(chosen) < len(order):
        one = one.where(F.col("doc_id").isin(chosen["doc_id"].tolist()))
    sample = one.toPandas().sort_values("doc_id", kind="stable")
    discard(stored)
    return sample


def fitting(sizes: np.ndarray, most: int) -> np.ndarray:
    """Which sizes, taken in order, have room in most together: one that has none is passed over, and the next ones are tried."""
    taken, room = np.zeros(len(sizes), bool), most
    for k, size in enumerate(sizes.tolist()):
        if size <= room:
            taken[k], room = True, room - size
    return taken


def fit(docs: DataFrame, labels: DataFrame) -> ByteConvNet:
    sample = training_sample(docs, labels)
    chunks = [chunk_matrix(np.frombuffer(x.encode(), np.uint8)) for x in sample["text"]]
    return train(chunks, (sample["quality"].to_numpy() > 0).astype(np.float32))


def score_quality(docs: DataFrame, net: ByteConvNet, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """keep and the score for every row."""

    def run(batches):
        tables = net.pair_tables()
        for b in slices(batches):
            scores = pa.array([net.score(x, tables) for x in texts(b)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), scores], [*keep, name])

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` double"]))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", crc_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
