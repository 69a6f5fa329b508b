"""Exact top-k search by distributed histogram selection.

Every vector is scored against every query, a block of queries and a tile of vectors at a time; nothing but histograms
of scores leaves a task. Round after round the histogram of each query is narrowed to the bin that holds its k-th
highest score, until that score is known exactly. A last pass keeps what lies above it, and of the ties with it those
with the smallest ids. All figures are integers, so the result does not depend on the order of rows. They are held in
floats while every product is below 2^53, in 64 bits below 2^62 and as integers of any size beyond, so no score is cut.

The queries' state (bounds and how many are still to be found) is a table of blocks in the shared folder; it grows with
the queries and is never collected. Blocks are worked through in waves of WAVE, and one wave, of bounded size, is sent to
every executor at a time.

Vectors that are null, or hold null, NaN or infinite components, take no part; vectors of unequal length are filled up
with zeros. A query's own row, and any row with its vec_id, is no candidate; of query rows with one vec_id one is used, whichever comes first where their vectors differ. Fewer candidates
than k give all of them. A score that a long cannot hold is returned as the nearest long, but ranked as it is. Extra
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table

SCALE, K, BINS = 1024, 10, 1024
QUERIES_A_BLOCK, VECTORS_A_TILE = 256, 2048
#: Blocks that are sent to every executor together.
WAVE = 32
#: Below these the scores are exact in floats, or in 64 bits.
IN_FLOATS, IN_LONGS = 1 << 53, 1 << 62
LONGEST = (1 << 63) - 1
BLOCK = "wave int, block bigint, n int, ids binary, vectors binary"
#: low: where each query's range begins; the range is span wide.
STATE = f"{BLOCK}, low binary, span string, need binary"


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id and v, the components as doubles; only rows that take part."""
    infinite = F.lit(float("inf"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == infinite))
    some = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    return some.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def matrices(batches: Iterator[pa.RecordBatch], dim: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(SCALE * x) [n, dim], whole numbers as doubles) of at most rows vectors."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            part = b.slice(k, rows)
            lists = part.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            out = np.zeros((part.num_rows, dim), np.float64)
            out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(flat * SCALE)
            yield part.column("vec_id").to_numpy(), out


def tiles(vectors: DataFrame, dim: int) -> DataFrame:
    def run(batches):
        for ids, v in matrices(batches, dim, VECTORS_A_TILE):
            yield pa.RecordBatch.from_pydict({"tile_n": pa.array([len(ids)], pa.int32()), "tile_ids": [ids.tobytes()], "tile_vectors": [v.tobytes()]})

    return vectors.mapInArrow(run, "tile_n int, tile_ids binary, tile_vectors binary")


class Numbers:
    """Scores in the narrowest form that holds them all: floats and 64 bits, or integers of any size."""

    def __init__(self, bound: int):
        self.in_floats, self.in_longs = bound < IN_FLOATS, bound < IN_LONGS
        self.least = -bound - 1

    def scores(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        if self.in_floats:
            return (q @ v.T).astype(np.int64)
        if self.in_longs:
            return q.astype(np.int64) @ v.T.astype(np.int64)
        whole = np.frompyfunc(int, 1, 1)
        return whole(q) @ whole(v).T

    def pack(self, x: list[int]) -> bytes:
        return np.array(x, np.int64).tobytes() if self.in_longs else ",".join(map(str, x)).encode()

    def unpack(self, raw: bytes) -> np.ndarray:
        if self.in_longs:
            return np.frombuffer(raw, np.int64)
        return np.array([int(x) for x in raw.split(b",")], object)


def state_rows(wave: int, block: int, ids: bytes, vectors: bytes, n: int, low: bytes, span: int, need: bytes) -> pa.RecordBatch:
    values = [pa.array([wave], pa.int32()), pa.array([block]), pa.array([n], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids, vectors, low)), pa.array([str(span)]), pa.array([need], pa.binary())]
    return pa.RecordBatch.from_arrays(values, ["wave", "block", "n", "ids", "vectors", "low", "span", "need"])


def query_blocks(queries: DataFrame, dim: int, blocks: int, numbers: Numbers, span: int, k: int) -> DataFrame:
    """A row a block of queries, with the state that each begins with."""

    def run(batches):
        for b in batches:
            dealt = b.column("dealt").to_numpy()
            for x in np.unique(dealt).tolist():
                part = b.filter(pa.array(dealt == x))
                for ids, v in matrices(iter([part]), dim, QUERIES_A_BLOCK):
                    n = len(ids)
                    yield state_rows(x // WAVE, int(ids.min()), ids.tobytes(), v.tobytes(), n, numbers.pack([numbers.least] * n), span, np.full(n, k, np.int64).tobytes())

    dealt = queries.withColumn("dealt", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition(max(1, blocks), "dealt").sortWithinPartitions("dealt", "vec_id")
    return dealt.mapInArrow(run, STATE)


def pairs_of(batches: Iterator[pa.RecordBatch], dim: int, numbers: Numbers) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """For each tile and block: the block's state, its queries' ids, the tile's ids, and the scores (own rows below all others)."""
    for b in batches:
        for r in b.to_pylist():
            ids, own = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["tile_ids"], np.int64)
            s = numbers.scores(np.frombuffer(r["vectors"]).reshape(-1, dim), np.frombuffer(r["tile_vectors"]).reshape(-1, dim))
            s[ids[:, None] == own[None, :]] = numbers.least - 1
            yield r, ids, own, s


def hist_row(block: int, hist: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([hist.astype(np.int64).tobytes()], pa.binary())], ["block", "hist"])


def histogram_round(tile_rows: DataFrame, state: DataFrame, dim: int, numbers: Numbers) -> DataFrame:
    """One histogram a block, of the scores in each query's present range; then the state narrowed to the k-th's bin."""

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for r, ids, _, s in pairs_of(batches, dim, numbers):
            low, span = numbers.unpack(r["low"])[:, None], int(r["span"])
            width = -(-span // BINS)
            inside = ((s >= low) & (s < low + span)).astype(bool)
            row, _ = np.nonzero(inside)
            at = ((s - low)[inside] // width).astype(np.int64)
            hist = np.bincount(row * BINS + at, minlength=len(ids) * BINS)
            held[r["block"]] = held.get(r["block"], 0) + hist
            if len(held) > 16:
                yield from (hist_row(*x) for x in held.items())
                held = {}
        yield from (hist_row(*x) for x in held.items())

    def total(batches):
        now, hist = None, None
        for b in batches:
            for block, h in zip(b.column("block").to_pylist(), b.column("hist").to_pylist(), strict=True):
                if block != now:
                    if hist is not None:
                        yield hist_row(now, hist)
                    now, hist = block, np.zeros(len(h) // 8, np.int64)
                hist = hist + np.frombuffer(h, np.int64)
        if hist is not None:
            yield hist_row(now, hist)

    def narrow(batches):
        for b in batches:
            for r in b.to_pylist():
                low, need, width = numbers.unpack(r["low"]), np.frombuffer(r["need"], np.int64), -(-int(r["span"]) // BINS)
                hist = np.frombuffer(r["hist"], np.int64).reshape(len(low), BINS) if r["hist"] else np.zeros((len(low), BINS), np.int64)
                above = np.cumsum(hist[:, ::-1], 1)[:, ::-1]
                bin_at = (above >= need[:, None]).sum(1) - 1  # the last bin from which on enough scores lie
                rows = np.arange(len(low))
                over = np.where(bin_at + 1 < BINS, above[rows, np.minimum(bin_at + 1, BINS - 1)], 0)
                new_low = [a + max(k, 0) * width for a, k in zip(low.tolist(), bin_at.tolist(), strict=True)]
                new_need = np.where(bin_at < 0, need, need - over)
                yield state_rows(r["wave"], r["block"], r["ids"], r["vectors"], r["n"], numbers.pack(new_low), width, new_need.tobytes())

    partial = tile_rows.crossJoin(F.broadcast(state)).mapInArrow(count, "block bigint, hist binary")  # a wave of blocks
    summed = partial.repartition("block").sortWithinPartitions("block").mapInArrow(total, "block bigint, hist binary")
    return state.join(summed, "block", "left").select("wave", "block", "n", "ids", "vectors", "low", "span", "need", "hist").mapInArrow(narrow, STATE)


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query (a subset of rows) among all rows."""
    v = quantised(rows)
    q = quantised(queries).dropDuplicates(["vec_id"])
    size = lambda df: df.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    (_, dim, most), (n, _, most_q) = size(v), size(q)
    dim = max(1, dim or 0)
    highest = lambda x: int(math.ceil((x or 0.0) * SCALE)) + 1
    numbers = Numbers(dim * highest(most) * highest(most_q))
    first_span = -2 * numbers.least + 1
    tile_rows = materialise(tiles(v, dim))
    blocks = max(1, math.ceil((n or 0) / QUERIES_A_BLOCK))
    every = materialise(query_blocks(q, dim, blocks, numbers, first_span, k))
    found = [selected(tile_rows, every.where(F.col("wave") == w), first_span, dim, numbers) for w in range(math.ceil(blocks / WAVE))]
    order = Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def selected(tile_rows: DataFrame, state: DataFrame, span: int, dim: int, numbers: Numbers) -> DataFrame:
    """query_id, vec_id, score and place (sorts as the scores do) of all rows above the k-th score of each query of a wave, and of the ties that may be needed."""
    while span > 1:
        before, state = state, materialise(histogram_round(tile_rows, state, dim, numbers))
        discard(before)
        span = -(-span // BINS)
    digits = len(str(-3 * numbers.least))

    def last(batches):
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for r, ids, own, s in pairs_of(batches, dim, numbers):
            low_q, need = numbers.unpack(r["low"]), np.frombuffer(r["need"], np.int64)
            row, col = np.nonzero(((s >= low_q[:, None]) & (s >= numbers.least)).astype(bool))
            held.setdefault(r["block"], []).append((ids[row], own[col], s[row, col], low_q[row], need[row]))
            if sum(len(x[0]) for x in held[r["block"]]) > 1 << 18:
                held[r["block"]] = [prune(held[r["block"]])]
        for parts in held.values():
            query, vec, score, *_ = prune(parts)
            places = [str(x - numbers.least).zfill(digits) for x in score.tolist()]
            clipped = [max(-LONGEST - 1, min(LONGEST, x)) for x in score.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(clipped, pa.int64()), pa.array(places, pa.string())], ["query_id", "vec_id", "score", "place"])

    def prune(parts):
        """Of the scores equal to a query's k-th only as many as may be needed, those of the smallest ids."""
        query, vec, score, low_q, need = (np.concatenate(x) for x in zip(*parts, strict=True))
        tie = (score == low_q).astype(bool)
        order = np.lexsort((vec, ~tie, query))
        query, vec, score, low_q, need, tie = (x[order] for x in (query, vec, score, low_q, need, tie))
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = ~tie | (place < need)
        return tuple(x[keep] for x in (query, vec, score, low_q, need))

    return tile_rows.crossJoin(F.broadcast(state)).mapInArrow(last, "query_id bigint, vec_id bigint, score bigint, place string")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
