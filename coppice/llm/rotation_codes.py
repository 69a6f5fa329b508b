"""Embedding near-dedup by randomised-rotation binary codes.

Unit vectors are rotated at random; a code keeps the signs, and beside it is stored the inner product of the vector with
its code, the factor that makes the estimate <code, other> / factor of an inner product unbiased. Its error has a known
spread, so a bound of CONFIDENCE spreads tells which pairs can reach the threshold, and only these are computed exactly,
in double precision. A link is never taken from an estimate.

* Balls: vectors of one code that lie within a fourth of the linking angle of its first one are a ball. By the triangle
  inequality of angles all its members link; two balls link wholly or not at all unless their distance is within their
  radii of the linking angle, and only such balls are compared member by member, in blocks. So a group of near copies,
  however large, is counted and not expanded.
* Index: centroids of a sample of at most SAMPLE_BYTES; every ball lives with its nearest one and visits the PROBES
  nearest. Two balls meet if one visits the other's home; of two meetings that of the smaller home counts. Homes are cut
  into tiles of TILE balls and their visitors into segments, so no task holds a whole home.
* Tasks hand on the number of links of each ball and a star for each group of linked balls, never pairs; components are
  found on these.

Measured against brute force (tests): all links of near copies, and over 0.99 of random pairs at a cosine of 0.9.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Shorter vectors are filled up
with zeros. Rows are vectors of their own, also with equal or null vec_id; a class of rows without vec_id has a null
component_id and kept false. An empty table gives no rows. Extra columns, labels too, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table
from .simhash import components

THRESHOLD, CONFIDENCE, SEED = 0.9, 5.0, 7
BUCKET, TILE, SEGMENT, BLOCK, PROBES = 1024, 1024, 16_384, 512, 8
#: Of the vectors that the centroids are fitted on, and of the centroids, which are sent to every executor.
SAMPLE_BYTES, CENTROID_BYTES, A_CENTROID = 64 << 20, 16 << 20, 16
#: Angles nearer than this are compared member by member.
ROUNDING = 1e-6
LINKS, EDGE, UNSURE = 0, 1, 2


@lru_cache(4)
def rotation(size: int) -> np.ndarray:
    """An orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def code_size(dim: int) -> int:
    return max(64, -(-dim // 64) * 64)


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles."""
    v = raw.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def rotated(unit: np.ndarray) -> np.ndarray:
    size = code_size(unit.shape[1])
    return unit @ rotation(size)[: unit.shape[1]]


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs as bytes, and the inner product of each vector with its own code."""
    r = rotated(unit)
    return np.packbits(r > 0, axis=1), np.abs(r).sum(1) / math.sqrt(r.shape[1])


def estimates(code: np.ndarray, factor: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the cosines of coded vectors (rows) with rotated ones (columns)."""
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    return (signs @ other.astype(np.float32).T) / (math.sqrt(signs.shape[1]) * factor[:, None]).astype(np.float32)


def error_bounds(factor: np.ndarray, angle: np.ndarray, size: int) -> np.ndarray:
    """What the estimate of a cosine at most that angle apart may lack: the code's error is a random direction, of which the other vector has the sine."""
    return CONFIDENCE * np.sqrt(np.maximum(0, 1 - factor**2)) / factor * np.sin(np.minimum(angle, math.pi / 2)) / math.sqrt(size - 1)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the first of those it hangs together with."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def stacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of two equally long arrays of vectors, in double precision."""
    return np.einsum("ij,ij->i", units(a), units(b))


def coded_vectors(rows: DataFrame, dim: int, kind: str) -> DataFrame:
    """row, vec_id, raw, code, factor of the vectors that may link."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                lists = part.column("embedding")
                sizes = np.diff(lists.offsets.to_numpy())
                raw = np.zeros((part.num_rows, dim), kind)
                raw[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
                code, factor = codes(units(raw))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(factor)], ["vec_id", "raw", "code", "factor"])

    return materialise(rows.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, raw binary, code binary, factor double").withColumn("row", F.monotonically_increasing_id()))


def ball_members(vectors: DataFrame, kind: str, most: float) -> DataFrame:
    """row, vec_id, ball (the row of its first vector), angle from that."""

    def run(batches):
        for b in batches:
            row, first = b.column("row").to_numpy(), b.column("first").to_numpy(zero_copy_only=False)
            ball, angle = row.copy(), np.zeros(len(row))
            some = np.flatnonzero(~np.isnan(first.astype(np.float64)))
            some = some[first[some].astype(np.int64) != row[some]]
            if len(some):
                width = len(b.column("raw")[0].as_py()) // np.dtype(kind).itemsize
                at = pa.array(some)
                far = np.arccos(np.clip(cosines(stacked(b.column("raw").take(at), kind, width), stacked(b.column("lead").take(at), kind, width)), -1, 1))
                near = far <= most
                ball[some[near]], angle[some[near]] = b.column("first").take(at).to_numpy()[near], far[near]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), pa.array(ball), pa.array(angle)], ["row", "vec_id", "ball", "angle"])

    shared = vectors.groupBy("code").agg(F.min(F.struct("row", "raw")).alias("m"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    leads = materialise(shared.select("code", F.col("m.row").alias("first"), F.col("m.raw").alias("lead")))
    out = materialise(vectors.select("row", "vec_id", "code", "raw").join(leads, "code", "left").mapInArrow(run, "row bigint, vec_id bigint, ball bigint, angle double"))
    discard(leads)
    return out


def fitted_centroids(balls: DataFrame, n: int, dim: int, kind: str) -> np.ndarray:
    """Centroids of a sample of the balls, about one for BUCKET of them, by a few rounds of spherical k-means."""
    count = max(1, min(-(-n // BUCKET), CENTROID_BYTES // (4 * dim)))
    wanted = min(n, A_CENTROID * count, SAMPLE_BYTES // (8 * dim))
    share = math.ceil(wanted / max(1, n) * (1 << 30))
    some = balls.where(F.pmod(F.xxhash64("ball"), F.lit(1 << 30)) < share).select("ball", "raw").toArrow().sort_by("ball")
    raw = stacked(some["raw"], kind, dim) if some.num_rows else np.ones((1, dim), kind)
    sample = units(raw).astype(np.float32)
    centroids = sample[np.random.default_rng(SEED).permutation(len(sample))[:count]]
    for _ in range(4):
        near = np.concatenate([(sample[k : k + 4096] @ centroids.T).argmax(1) for k in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.where(size > 0, sums / np.maximum(size, 1e-30), centroids)
    return centroids.astype(np.float32)


def routed(balls: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """The balls with home, and visits, the centroids nearest to them."""
    probes = min(PROBES, len(centroids))

    def run(batches):
        for b in batches:
            near = units(stacked(b.column("raw"), kind, centroids.shape[1])).astype(np.float32) @ centroids.T
            home = near.argmax(1)
            near[np.arange(len(near)), home] = 9
            visits = np.argpartition(-near, probes - 1, axis=1)[:, :probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * probes, pa.int32()), pa.array(visits.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.astype(np.int32)), lists], [*b.schema.names, "home", "visits"])

    return materialise(balls.mapInArrow(run, "ball bigint, n bigint, radius double, least bigint, raw binary, code binary, factor double, home int, visits array<int>"))


def dealt(balls: DataFrame, tiles: np.ndarray, segments: np.ndarray) -> DataFrame:
    """key (home, tile, segment), role (0 owner, 1 of another tile of its home, 2 visitor) and the ball, a row for each place where it is compared."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                ball, home = b.column("ball").to_numpy().astype(np.uint64), b.column("home").to_numpy()
                drawn = (ball + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                drawn ^= drawn >> np.uint64(29)
                tile, lot = (drawn >> np.uint64(33)).astype(np.int64), (drawn & np.uint64(0x7FFFFFFF)).astype(np.int64)
                visits = b.column("visits").to_pylist()
                at, key, role = [], [], []
                for k, own in enumerate(home.tolist()):
                    t = int(tile[k] % tiles[own])
                    places = [(own, t, s, 0) for s in range(segments[own])]
                    places += [(own, other, int(lot[k] % segments[own]), 1) for other in range(t)]
                    places += [(c, other, int(lot[k] % segments[c]), 2) for c in visits[k] if c != own for other in range(tiles[c])]
                    at += [k] * len(places)
                    key += [(c << 40) + (u << 20) + s for c, u, s, _ in places]
                    role += [r for *_, r in places]
                for a in range(0, len(at), 8192):
                    rows = b.take(pa.array(at[a : a + 8192], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 8192], pa.int64()), pa.array(role[a : a + 8192], pa.int32()), *rows.columns], ["key", "role", *rows.schema.names])

    few = balls.select("ball", "n", "radius", "raw", "code", "factor", "home", "visits")
    return few.mapInArrow(run, "key bigint, role int, ball bigint, n bigint, radius double, raw binary, code binary, factor double, home int, visits array<int>")


class Balls:
    """Some balls as arrays."""

    def __init__(self, b: pa.RecordBatch, kind: str):
        width = len(b.column("raw")[0].as_py()) // np.dtype(kind).itemsize
        self.ball, self.n, self.radius, self.factor, self.home = (b.column(c).to_numpy() for c in ("ball", "n", "radius", "factor", "home"))
        self.unit = units(stacked(b.column("raw"), kind, width))
        self.code = stacked(b.column("code"), "u1", code_size(width) // 8)
        self.visits = b.column("visits").flatten().to_numpy().reshape(b.num_rows, -1)
        self.rotated = rotated(self.unit)


def linked(own: Balls, other: Balls, threshold: float, home: int | None = None, above: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure) of pairs that link for sure, or maybe. home: the bucket, of which the others are visitors; above: each pair once."""
    angle = math.acos(threshold)
    widest = angle + own.radius + other.radius.max(initial=0)
    least = np.cos(np.minimum(widest, math.pi)) - error_bounds(own.factor, widest, own.rotated.shape[1])
    i, j = np.nonzero(estimates(own.code, own.factor, other.rotated) >= (least - 1e-5)[:, None])
    if above:
        i, j = i[i < j], j[i < j]
    if home is not None:  # both visit each other: the smaller home counts
        twice = (own.visits[i] == other.home[j][:, None]).any(1) & (other.home[j] < home)
        i, j = i[~twice], j[~twice]
    cosine = np.einsum("ij,ij->i", own.unit[i], other.unit[j])
    room = own.radius[i] + other.radius[j]
    theta = np.arccos(np.clip(cosine, -1, 1))
    sure = np.where(room == 0, cosine >= threshold, theta + room <= angle - ROUNDING)
    maybe = ~sure & (room > 0) & (theta - room <= angle + ROUNDING)
    some = sure | maybe
    return i[some], j[some], sure[some]


def found_rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["kind", "a", "b"])


def compared(places: DataFrame, kind: str, threshold: float) -> DataFrame:
    """kind, a, b: links of a ball (LINKS: ball, how many), stars of linked balls (EDGE), balls to be compared by members (UNSURE)."""

    def rows(own: Balls, other: Balls, i: np.ndarray, j: np.ndarray, sure: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield found_rows(UNSURE, own.ball[i[~sure]], other.ball[j[~sure]])
        i, j = i[sure], j[sure]
        for me, you, x, y in ((own, other, i, j), (other, own, j, i)):
            total = np.bincount(x, you.n[y], len(me.ball)).astype(np.int64)
            at = np.flatnonzero(total)
            yield found_rows(LINKS, me.ball[at], total[at])
        if len(i):
            yield found_rows(EDGE, *stars(own.ball[i], other.ball[j]))

    def run(batches):
        now, parts, own = None, [], None

        def closed():
            """The owners of a key, all read; pairs among them belong to its first segment."""
            made = Balls(pa.concat_batches(parts), kind)
            if now & 0xFFFFF == 0:
                yield from rows(made, made, *linked(made, made, threshold, above=True))
            return made

        for whole in batches:
            key, role = whole.column("key").to_numpy(), whole.column("role").to_numpy()
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (role[1:] != role[:-1])))
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
                part = whole.slice(a, z - a)
                if key[a] != now:
                    if parts and own is None:
                        own = yield from closed()
                    now, parts, own = int(key[a]), [], None
                if role[a] == 0:
                    parts.append(part)
                elif parts:
                    if own is None:
                        own = yield from closed()
                    for k in range(0, part.num_rows, 2048):
                        other = Balls(part.slice(k, 2048), kind)
                        yield from rows(own, other, *linked(own, other, threshold, now >> 40 if role[a] == 2 else None))
        if parts and own is None:
            yield from closed()

    return materialise(places.repartition("key").sortWithinPartitions("key", "role").mapInArrow(run, "kind int, a bigint, b bigint"))


def by_members(unsure: DataFrame, members: DataFrame, vectors: DataFrame, balls: DataFrame, kind: str, threshold: float) -> DataFrame:
    """kind, a, b as of compared(), with rows instead of balls at LINKS: unsure pairs of balls, a block of each at a time."""

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (rows[rows["side"] == k] for k in (0, 1))
        if not len(left) or not len(right):
            return pd.DataFrame({"kind": [], "a": [], "b": []})
        unit = [units(np.stack([np.frombuffer(x, kind) for x in part["raw"]])) for part in (left, right)]
        hit = unit[0] @ unit[1].T >= threshold
        ends = [(LINKS, r, c) for part, count in ((left, hit.sum(1)), (right, hit.sum(0))) for r, c in zip(part["row"], count, strict=True) if c]
        if hit.any():
            ends.append((EDGE, rows["p"].iloc[0], rows["q"].iloc[0]))
        return pd.DataFrame(ends, columns=["kind", "a", "b"])

    blocks = balls.select(F.col("ball").alias("_ball"), F.ceil(F.col("n") / BLOCK).alias("_blocks"))
    some = unsure
    for c, x in (("p", "x"), ("q", "y")):
        some = some.join(blocks, F.col(c) == F.col("_ball")).withColumn(x, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_ball", "_blocks")
    some = materialise(some)
    ends = some.select(F.explode(F.array("p", "q")).alias("ball")).distinct()
    rows = members.join(ends, "ball").join(blocks, F.col("ball") == F.col("_ball")).join(vectors.select("row", "raw"), "row")
    rows = materialise(rows.select("row", "ball", F.pmod(F.xxhash64("row"), F.col("_blocks")).alias("block"), "raw"))
    sides = [some.join(rows, (F.col(c) == F.col("ball")) & (F.col(x) == F.col("block"))).select("p", "q", "x", "y", F.lit(k).alias("side"), "row", "raw") for k, (c, x) in enumerate((("p", "x"), ("q", "y")))]
    return materialise(sides[0].unionByName(sides[1]).groupBy("p", "q", "x", "y").applyInPandas(pairs, "kind int, a bigint, b bigint"))


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding): links at that cosine or more."""
    infinite = F.lit(float("inf"))
    usual = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == infinite)) & F.exists("embedding", lambda x: x != 0)
    marked = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").withColumn("_usual", F.coalesce(usual, F.lit(False)))
    good, alone = marked.where("_usual"), marked.where("not _usual")
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    if kind == "<f8":
        good = good.withColumn("embedding", F.col("embedding").cast("array<double>"))
    dim = max(1, good.agg(F.max(F.size("embedding"))).first()[0] or 0)
    angle = math.acos(threshold)
    vectors = coded_vectors(good, dim, kind)
    members = ball_members(vectors, kind, angle / 4)
    stats = members.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"), F.min("vec_id").alias("least"))
    balls = materialise(stats.join(vectors.select(F.col("row").alias("ball"), "raw", "code", "factor"), "ball"))
    centroids = fitted_centroids(balls, balls.count(), dim, kind)
    routes = routed(balls, centroids, kind)
    owners, visitors = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64)
    for r in routes.select("home", F.explode("visits").alias("c")).groupBy("c").agg(F.sum((F.col("c") == F.col("home")).cast("long")).alias("o"), F.count(F.lit(1)).alias("v")).collect():  # a row a centroid
        owners[r["c"]], visitors[r["c"]] = r["o"], r["v"]
    found = compared(dealt(routes, np.maximum(1, -(-owners // TILE)), np.maximum(1, -(-visitors // SEGMENT))), kind, threshold)
    unsure = found.where(F.col("kind") == UNSURE).select(F.col("a").alias("p"), F.col("b").alias("q"))
    edges = found.where(F.col("kind") == EDGE).select(F.col("a").alias("u"), F.col("b").alias("v"))
    more = None
    if unsure.limit(1).count():
        more = by_members(unsure, members, vectors, balls, kind, threshold)
        edges = edges.unionByName(more.where(F.col("kind") == EDGE).select(F.col("a").alias("u"), F.col("b").alias("v")))
    labels = components(edges)
    of_balls = found.where(F.col("kind") == LINKS).groupBy(F.col("a").alias("ball")).agg(F.sum("b").alias("more"))
    known = balls.select("ball", "n", "least").join(of_balls, "ball", "left").join(labels.withColumnRenamed("node", "ball"), "ball", "left")
    known = materialise(known.select("ball", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "ball").alias("component"), "least"))
    firsts = materialise(known.groupBy("component").agg(F.min("least").alias("component_id")))
    finished = materialise(known.join(firsts, "component").select("ball", "links", "component_id"))
    out = members.select("row", "vec_id", "ball").join(finished, "ball")
    if more is not None:
        extra = materialise(more.where(F.col("kind") == LINKS).groupBy(F.col("a").alias("row")).agg(F.sum("b").alias("extra")))
        out = out.join(extra, "row", "left").withColumn("links", F.col("links") + F.coalesce("extra", F.lit(0)))
    discard(vectors, balls, routes, found, known, firsts)
    whole = out.select("vec_id", F.col("links").alias("n_links"), "component_id").unionByName(alone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return whole.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), good AS (
  SELECT *, sqrt(list_inner_product(e, e)) AS size FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r, b.r AS other FROM good a JOIN good b ON a.r <> b.r WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.9
), reach AS (
  SELECT r, r AS other FROM v
  UNION
  SELECT reach.r, links.other FROM reach JOIN links ON links.r = reach.other
), least AS (
  SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.other GROUP BY reach.r
)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN least USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM links GROUP BY r) USING (r)
"""
