"""Quality rules by an isolation forest on rule statistics.

One pass over the whole texts gives a row of statistics a document. In an isolation forest (path lengths over random
splits) each tree is grown on a few rows that it draws from all documents, as the method has it, and the anomaly score
above which a document goes is calibrated on all labelled rows of both kinds: most of the bad ones go, and at most
max_good_loss of the good ones. Texts are read once; everything later reads the small table of statistics.

Null texts have no words. A document with fewer than 10 words or with over a fifth of its words in repeated 5-word
windows fails the base rules. Without labels of both kinds no document is called an anomaly. Repeated rows are judged
one by one, extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import kth
from .common import discard, first_rows_by_hash, materialise, slices, sorted_labels, table, texts

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Words of a window in which different words are counted, so that the statistic does not fall with length.
SPAN = 200
N_TREES, SUBSAMPLE = 100, 64
#: Draws of all trees together, each a row of its own where there are so many.
FOREST_ROWS = N_TREES * SUBSAMPLE
MAX_GOOD_LOSS = 0.004
SEED = 20240501
FEATURES = ("symbols", "upper", "punctuation", "digits", "dup_lines", "repeats", "word_length", "short_words", "distinct")
#: Half the spread between the tenths below and above counts as one unit of a statistic, at least this much of it.
LEAST_UNIT = (0.02, 0.02, 0.02, 0.05, 0.1, 0.05, 0.3, 0.05, 0.05)
#: Units from the median that are ordinary, and units beyond these after which nothing is added.
ORDINARY, FARTHEST = 3.0, 20.0
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 5-word window found twice or more. Windows with equal hashes are compared themselves."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    w = h[: n - WINDOW + 1].copy()
    for k in range(1, WINDOW):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : n - WINDOW + 1 + k]
    _, back, count = np.unique(w, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[back] > 1)
    if not len(starts):
        return 0
    found = Counter(windows := [tuple(words[i : i + WINDOW]) for i in starts.tolist()])
    starts = starts[[found[x] > 1 for x in windows]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:n])))


def mean_distinct(words: list[bytes]) -> float:
    """Part of the words of a window that are different, mean over all windows of SPAN words (or the one of all words)."""
    n = len(words)
    span = min(n, SPAN)
    if not n:
        return 0.0
    last: dict[bytes, int] = {}
    before = np.empty(n, np.int64)
    for i, w in enumerate(words):
        before[i] = last.get(w, -1)
        last[w] = i
    at = np.arange(n)
    # A word counts in the windows that begin after its place before and hold it.
    held = np.minimum(at, n - span) - np.maximum(np.maximum(at - span, before) + 1, 0) + 1
    return int(np.maximum(held, 0).sum()) / ((n - span + 1) * span)


def statistics(text: bytes) -> tuple:
    """BASE, then FEATURES."""
    words = text.split()  # white space of bytes is exactly \x20 and \x09-\x0D
    n = len(words)
    raw = np.frombuffer(text, np.uint8)
    of = np.bincount(raw, minlength=256)
    points = len(text) - int(of[0x80:0xC0].sum())
    word_chars = points - int(of[0x20]) - int(of[0x09:0x0E].sum())
    n_symbols = int(of[list(SYMBOLS)].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeated = repeat_words(words)
    chars, full = max(1, word_chars), max(1, n)
    upper, digits = int(of[65:91].sum()), int(of[48:58].sum())
    marks = int(of[[33, 34, 39, 40, 41, 44, 45, 46, 47, 58, 59, 61, 63, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]].sum())
    return (n, word_chars, n_symbols, dup, repeated, n_symbols / chars, upper / chars, marks / chars, digits / chars, dup / max(1, len(lines)), repeated / full, word_chars / full, sum(len(x) < 3 for x in words) / full, mean_distinct(words))


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, BASE and FEATURES of every document's whole text."""

    def run(batches):
        for b in slices(batches):
            cols = list(zip(*map(statistics, texts(b)), strict=True)) or [()] * (len(BASE) + len(FEATURES))
            kinds = [pa.int64()] * len(BASE) + [pa.float64()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", *BASE, *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", *(f"{c} bigint" for c in BASE), *(f"{c} double" for c in FEATURES)]))


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class IsolationForest:
    """Trees as flat arrays; depth is at most log2 of the subsample. Of rows in random order each tree has its own, where they suffice; else trees draw anew from all."""

    def __init__(self, rows: np.ndarray, trees: int = N_TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(2, self.size))))
        drawn = lambda k: rows[k * self.size : (k + 1) * self.size] if len(rows) >= trees * self.size else rows[rng.choice(len(rows), self.size, replace=False)]
        self.trees = [self._grow(drawn(k), rng) for k in range(trees)] if len(rows) > 1 else []

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, length = [], [], [], [], []

        def add(part: np.ndarray, depth: int) -> int:
            k = len(feature)
            for x, v in zip((feature, cut, left, right, length), (-1, 0.0, k, k, depth + _average_path(len(part))), strict=True):
                x.append(v)
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else []
            if depth < self.depth and len(spread):
                f = int(rng.choice(spread))
                feature[k], cut[k] = f, float(rng.uniform(part[:, f].min(), part[:, f].max()))
                goes = part[:, f] <= cut[k]
                left[k], right[k] = add(part[goes], depth + 1), add(part[~goes], depth + 1)
            return k

        add(rows, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; the higher, the easier a row is isolated."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total, all_rows = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = np.where(rows[all_rows, feature[at]] <= cut[at], left[at], right[at])
            total += length[at]
        return np.exp2(-total / len(self.trees) / max(_average_path(self.size), 1e-9))


def excess(rows: np.ndarray, middle: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """How far each rule statistic lies outside its ordinary range; 0 within it, so that splits meet real oddities only."""
    return np.log1p(np.clip(np.abs(rows - middle) / unit - ORDINARY, 0, FARTHEST))


def calibrate(scores: np.ndarray, good: np.ndarray, max_good_loss: float = MAX_GOOD_LOSS) -> float:
    """The threshold that rejects the most bad rows while at most that part of the good ones goes, as high as it can be without
    letting one of these bad rows through. Infinite without rows of both kinds, or where no bad row is to be had so."""
    if not good.any() or good.all():
        return math.inf
    of_good = np.sort(scores[good])
    lowest = of_good[min(len(of_good) - 1, math.ceil(len(of_good) * (1 - max_good_loss)) - 1)]
    above = scores[~good][scores[~good] > lowest]
    if not len(above):
        return math.inf
    below = scores[scores < above.min()]
    return float((above.min() + below.max()) / 2)


def calibrated(scored: DataFrame, max_good_loss: float = MAX_GOOD_LOSS) -> float:
    """calibrate() for a table of quality and anomaly, however many rows it has: ranks and bounds by aggregates, only numbers come to the driver."""
    good, anomaly = F.col("quality") == 1, F.col("anomaly")
    n, bad = scored.agg(F.count_if(good), F.count_if(~good)).first()
    if not n or not bad:
        return math.inf
    lowest, *_ = kth(scored.where(good), anomaly, math.ceil(n * (1 - max_good_loss)) or n, n=n)
    above = scored.where(~good & (anomaly > lowest)).agg(F.min(anomaly)).first()[0]
    if above is None:
        return math.inf
    return (above + scored.where(anomaly < above).agg(F.max(anomaly)).first()[0]) / 2


def quality_rules(docs: DataFrame, labels: DataFrame, max_good_loss: float = MAX_GOOD_LOSS) -> DataFrame:
    """A row a document: BASE, base_failed, anomaly, kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = materialise(rule_statistics(docs))
    passing = stats.where(~failed).select("doc_id", *FEATURES)
    tenths = passing.agg(*(F.percentile_approx(c, [0.1, 0.5, 0.9], 1000).alias(c) for c in FEATURES)).first()
    low, middle, high = (np.array([(tenths[c] or (0, 0, 0))[k] for c in FEATURES]) for k in range(3))
    unit = np.maximum((high - low) / 2, LEAST_UNIT)
    sample = first_rows_by_hash(passing, "doc_id", FOREST_ROWS).toPandas()
    forest = IsolationForest(excess(sample[list(FEATURES)].to_numpy(float), middle, unit))

    def scored(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        def run(batches):
            for b in batches:
                rows = np.column_stack([b.column(c).to_numpy() for c in FEATURES]) if b.num_rows else np.zeros((0, len(FEATURES)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(forest.score(excess(rows, middle, unit)))], [*keep, "anomaly"])

        kinds = dict(df.dtypes)
        return df.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "anomaly double"]))

    # One row of each labelled doc_id, however often it stands in the table.
    once = passing.join(sorted_labels(labels, "quality"), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*FEATURES)).alias("x")).select("quality", "x.*")
    known = materialise(scored(once, ("quality",)))
    threshold = calibrated(known, max_good_loss)
    discard(known)
    verdict = scored(stats, ("doc_id", *BASE))
    return verdict.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(threshold)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
