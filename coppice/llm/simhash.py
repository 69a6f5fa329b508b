"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of all documents are made in one map. Distinct fingerprints are then linked: the 64 bits are grouped into
partitions so that correlated bits stand together, a threshold for each partition (unequal, possibly none) is chosen by
dynamic programming on candidate counts estimated from histograms over all fingerprints, each fingerprint is probed in
its partitions' buckets within the threshold, and candidates are verified on all 64 bits. Two fingerprints that differ
in at most DISTANCE bits meet in at least one bucket, because the thresholds t add up so that sum(t + 1) = DISTANCE + 1.

A bucket hands on a spanning forest of its links, never all pairs; components are found by alternating large and small
stars on tables in the shared folder. Copies with one fingerprint are one node.

Null and empty texts have fingerprint zero and are linked like any others. Fewer than four words are one shingle. Equal
rows share a component; rows without doc_id keep a null component_id unless others share theirs. Extra columns are not
read. Counts over all fingerprints are bounded tables (64 x 64 bit pairs, 65,536 cells a partition).

near_copies judges similarity instead: the same search, wide enough for edited copies, runs over FINDERS fingerprints of
FIND-word shingles; what it finds is joined to minimal spanning forests by fingerprints of 64 * WIDE bits over five-word
shingles, and each link of these is checked on the texts: a Jaccard similarity of five-word shingles of 0.8. Null and empty texts are copies of each other; rows without doc_id count
last, and of rows with one doc_id and text one stays.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, slices, table, texts

SHINGLE, SEED, BITS, DISTANCE = 4, 42, 64, 4
#: Partitions that may be chosen, and nanoseconds that a probe row and a compared pair cost, for the choice.
PARTITION_COUNTS, ROW_COST, PAIR_COST = (2, 3, 4, 5), 3000.0, 10.0
#: Bits of a partition's histogram.
HIST_BITS = 14
#: Largest bucket that is compared member by member; larger ones meet at fingerprints in between.
COMPARED = 4096
#: near_copies finds by FINDERS fingerprints over shingles of FIND words, in one of which FIND_DISTANCE bits differ at most.
FIND, FINDERS, FIND_DISTANCE = 2, 2, 7
#: It judges by the angle between fingerprints of WIDE words over shingles of JUDGE words, with so much room for the angle's error, and then by the shingles.
JUDGE, WIDE, SIMILARITY, ROOM = 5, 8, 0.8, 0.04
#: Pairs compared together, and pairs of a bucket up to which they are laid out flat.
PAIRS, FLAT = 1 << 19, 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit by bit the majority of the XXH64 of all shingles; zero without words."""
    words = text.lower().split()  # bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    count, total = np.zeros(BITS, np.int64), n - shingle + 1
    for k in range(0, total, 65536):
        pairs = zip(starts[k : min(k + 65536, total)].tolist(), ends[k + shingle - 1 :].tolist(), strict=False)
        h = np.array([digest(line[a:b], SEED) for a, b in pairs], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(x) for x in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp bigint")


def bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set: 64 x 64 counts, summed where the rows are."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS), np.float64)
        for b in slices(batches, 65536):
            bits = bit_matrix(b.column("fp").to_numpy().view(np.uint64)).astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([both.astype(np.int64).ravel().tolist()], pa.list_(pa.int64()))], ["n", "both"])

    made = nodes.select("fp").mapInArrow(run, "n bigint, both array<bigint>")
    got = made.select("n", F.posexplode("both").alias("k", "v")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # 4096 rows
    both = np.zeros(BITS * BITS)
    for r in got:
        both[r["k"]] = r["v"]
    return (int(got[0]["n"]) if got else 0), both.reshape(BITS, BITS)


def partition_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in partitions of equal size, correlated ones together: each grows by the bit most correlated with it."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def take_bits(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def histograms(nodes: DataFrame, layouts: dict[int, list[list[int]]]) -> dict[tuple[int, int], np.ndarray]:
    """(parts, partition) -> counts of the values of its first HIST_BITS bits, over all fingerprints."""
    flat = [(m, i, bits[:HIST_BITS]) for m, groups in layouts.items() for i, bits in enumerate(groups)]

    def run(batches):
        cells = np.zeros((len(flat), 1 << HIST_BITS), np.int64)
        for b in slices(batches, 65536):
            fps = b.column("fp").to_numpy().view(np.uint64)
            for k, (_, _, bits) in enumerate(flat):
                cells[k] += np.bincount(take_bits(fps, bits).astype(np.int64), minlength=1 << HIST_BITS)
        for k in range(len(flat)):
            at = np.flatnonzero(cells[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(cells[k, at])], ["k", "cell", "n"])

    got = nodes.select("fp").mapInArrow(run, "k int, cell int, n bigint").groupBy("k", "cell").agg(F.sum("n").alias("n")).toPandas()
    out = {(m, i): np.zeros(1 << HIST_BITS) for m, i, _ in flat}
    for k, part in got.groupby("k"):
        out[flat[k][:2]][part["cell"].to_numpy()] = part["n"].to_numpy()
    return out


def balls(bits: int, radius: int) -> int:
    return sum(math.comb(bits, r) for r in range(radius + 1))


def candidate_counts(hist: np.ndarray, bits: int, most: int) -> list[float]:
    """Pairs expected in a partition's buckets for each radius up to most; the histogram has its first bits, the rest are taken as even."""
    seen = min(bits, HIST_BITS)
    spectrum = [hist]
    near, out = hist.copy(), []
    for radius in range(most + 1):
        if radius:  # neighbours at exactly this radius, by the recurrence of the hypercube's distance matrices
            last = spectrum[-1]
            flips = sum(last[np.arange(len(hist)) ^ (1 << b)] for b in range(seen))
            spectrum.append((flips - (seen - radius + 2) * spectrum[-2]) / radius if radius > 1 else flips)
            near = near + spectrum[-1]
        share = balls(bits, radius) / balls(seen, radius) / 2.0 ** (bits - seen)
        out.append(float((hist * near).sum()) * share)
    return out


def thresholds(n: int, sizes: list[int], hists: list[np.ndarray], distance: int = DISTANCE) -> tuple[float, list[int]]:
    """Cost and thresholds (-1: not probed) with sum(t + 1) = distance + 1, by dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits, hist in zip(sizes, hists, strict=True):
        pairs = candidate_counts(hist, bits, min(distance, 3))
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(distance, 3) + 1):
                if used + t + 1 <= distance + 1:
                    more = 0.0 if t < 0 else ROW_COST * n * balls(bits, t) + PAIR_COST * pairs[t]
                    now = (cost + more, [*chosen, t])
                    if used + t + 1 not in after or now < after[used + t + 1]:
                        after[used + t + 1] = now
        best = after
    return best.get(distance + 1, (math.inf, []))


def plan(nodes: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, of the cheapest layout."""
    n, both = bit_counts(nodes)
    layouts = {m: partition_bits(n, both, m) for m in PARTITION_COUNTS}
    hists = histograms(nodes, layouts)
    found = [(*thresholds(n, [len(g) for g in groups], [hists[m, i] for i in range(m)], distance), groups) for m, groups in layouts.items()]
    _, chosen, groups = min(found, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]


def masks(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def probes(nodes: DataFrame, layout: list[tuple[list[int], int]]) -> DataFrame:
    """A row for each partition and each value within its threshold: part, key, fp, rep."""

    def run(batches):
        for b in slices(batches, 2048):
            fps, rep = b.column("fp").to_numpy().view(np.uint64), b.column("rep")
            for k, (bits, t) in enumerate(layout):
                m = masks(len(bits), t)
                keys = (take_bits(fps, bits)[:, None] ^ m[None, :]).ravel().view(np.int64)
                at = pa.array(np.repeat(np.arange(len(fps)), len(m)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys), b.column("fp").take(at), rep.take(at)], ["part", "key", "fp", "rep"])

    return nodes.select("fp", "rep").mapInArrow(run, "part int, key bigint, fp bigint, rep bigint")


def forest(fps: np.ndarray, reps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Spanning forest of the links among the members of one bucket."""
    if len(fps) > COMPARED and distance % 2 == 0:
        return forest_between(fps, reps, distance)
    out = []
    alone = np.ones(len(fps), bool)
    for i in range(len(fps)):
        if not alone[i]:
            continue
        alone[i] = False
        queue = [i]
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(alone)
            if not len(rest):
                return out
            near = rest[np.bitwise_count(fps[rest] ^ fps[x]) <= distance]
            if len(near):
                alone[near] = False
                queue.extend(near.tolist())
                out.extend((int(reps[x]), int(r)) for r in reps[near].tolist())
    return out


def forest_between(fps: np.ndarray, reps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """The same for a large bucket, without comparing all: links meet at values half way. Exact, linear in the members."""
    half = masks(BITS, distance // 2)
    label = np.arange(len(fps))

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = int(label[x])
        return x

    out: list[tuple[int, int]] = []
    step = max(1, (1 << 22) // len(fps))
    waves = max(1, len(fps) * len(half) >> 24)
    for wave in range(waves):  # values are dealt into waves, so that those of one wave fit in memory
        found_v, found_i = [], []
        for k in range(0, len(half), step):
            v = fps[:, None] ^ half[None, k : k + step]
            at = np.nonzero((v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(waves) == wave)
            found_v.append(v[at])
            found_i.append(at[0])
        v, i = np.concatenate(found_v), np.concatenate(found_i)
        order = np.argsort(v, kind="stable")
        v, i = v[order], i[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        for a, b in zip(i[same].tolist(), i[same + 1].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                label[max(ra, rb)] = min(ra, rb)
                out.append((int(reps[a]), int(reps[b])))
    return out


def links(nodes: DataFrame, layout: list[tuple[list[int], int]], distance: int = DISTANCE) -> DataFrame:
    """(u, v): spanning forests of all buckets."""

    def run(batches):
        key, fps, reps = [], [], []
        for b in batches:
            key.append(b.column("part").to_numpy().astype(np.int64) * 1_000_003 + b.column("key").to_numpy())
            fps.append(b.column("fp").to_numpy().view(np.uint64))
            reps.append(b.column("rep").to_numpy())
        out: list[tuple[int, int]] = []
        if key:
            k, f, r = np.concatenate(key), np.concatenate(fps), np.concatenate(reps)
            order = np.lexsort((f, k))
            k, f, r = k[order], f[order], r[order]
            once = np.ones(len(k), bool)
            once[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
            k, f, r = k[once], f[once], r[once]
            cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if z - a > 1:
                    out += forest(f[a:z], r[a:z], distance)
        edges = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

    return probes(nodes, layout).repartition("part", "key").mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge. Alternating large and small stars."""

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs if small else pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        joined = both.join(least, "u")
        if small:  # here u > v; u itself joins the star of its least neighbour
            return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()

    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        after = materialise(star(star(now, False), True))
        discard(now)
        seen, now = mark, after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    fps = materialise(fingerprints(docs))
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").cast("bigint").alias("rep")).where("rep is not null"))
    labels = components(links(nodes, plan(nodes, distance), distance))
    of_fp = nodes.join(labels, nodes["rep"] == labels["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of_fp, "fp", "left").select("doc_id", "fp", "component_id")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all shingles of so many words; fewer words are one shingle."""
    n = max(1, len(words) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(min(size, len(words))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return out


def majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of so many 64-bit words: each bit is that of most hashes, which every word draws anew."""
    count = np.zeros(BITS * words, np.int64)
    step = 255 * 64  # bytes hold sums of 255
    for k in range(0, len(hashes), step):
        part = hashes[k : k + step]
        drawn = np.zeros((-(-len(part) // 255) * 255, words), "<u8")
        for w in range(words):
            drawn[: len(part), w] = mixed(part + np.uint64((w * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
        bits = np.unpackbits(drawn.view(np.uint8), axis=1, bitorder="little")
        count += bits.reshape(-1, 255, BITS * words).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")


def wide_fingerprint(text: bytes) -> np.ndarray:
    """FINDERS words to find a text by, and WIDE words to judge it by; zeros without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(FINDERS + WIDE, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.concatenate([majority(shingle_hashes(h, FIND), FINDERS), majority(shingle_hashes(h, JUDGE), WIDE)])


def most_bits(similarity: float) -> int:
    """Bits of WIDE words that differ where five-word shingles have that Jaccard similarity."""
    return int(BITS * WIDE * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def bucket_rows(nodes: DataFrame, layout: list[tuple[list[int], int]]) -> DataFrame:
    """bucket, own, fp, node: each fingerprint in its own bucket of every partition, and as a visitor in those within its threshold."""

    def run(batches):
        for b in slices(batches, 2048):
            fps, node = b.column("fp").to_numpy().view(np.uint64), b.column("node")
            for k, (bits, t) in enumerate(layout):
                m = masks(len(bits), t)
                keys = (take_bits(fps, bits)[:, None] ^ m[None, :] | np.uint64(k << 56)).ravel().view(np.int64)
                at = pa.array(np.repeat(np.arange(len(fps)), len(m)))
                own = pa.array(np.tile(m == 0, len(fps)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), own, b.column("fp").take(at), node.take(at)], ["bucket", "own", "fp", "node"])

    return nodes.select("fp", "node").mapInArrow(run, "bucket bigint, own boolean, fp bigint, node bigint")


def found_groups(own: np.ndarray, fps: np.ndarray, cuts: np.ndarray, distance: int) -> list[np.ndarray]:
    """Members (indices) that hang together by pairs of an owner and another within the distance, of each bucket cuts[k]..cuts[k + 1]. Owners come first."""
    sizes = np.diff(cuts)
    owners = np.add.reduceat(own, cuts[:-1], dtype=np.int64)
    out: list[np.ndarray] = []
    for k in np.flatnonzero(owners * sizes > FLAT).tolist():
        out += dense_groups(own[cuts[k] : cuts[k + 1]], fps[cuts[k] : cuts[k + 1]], distance, int(cuts[k]))
    flat = owners * sizes <= FLAT
    first = np.flatnonzero(own & np.repeat(flat, sizes))
    rest = np.repeat(cuts[1:], sizes)[first] - first - 1  # members after it
    label: dict[int, int] = {}

    def root(x: int) -> int:
        while label.setdefault(x, x) != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    upto = np.cumsum(rest)
    a = 0
    while a < len(first):
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        i, n = first[a:z], rest[a:z]
        left = np.repeat(i, n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        near = np.flatnonzero(np.bitwise_count(fps[left] ^ fps[right]) <= distance)
        for x, y in zip(left[near].tolist(), right[near].tolist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                label[max(rx, ry)] = min(rx, ry)
        a = z
    groups: dict[int, list[int]] = {}
    for x in label:
        groups.setdefault(root(x), []).append(x)
    return out + [np.array(sorted(g)) for g in groups.values()]


def dense_groups(own: np.ndarray, fps: np.ndarray, distance: int, offset: int) -> list[np.ndarray]:
    """The same for one large bucket, member by member among those not reached yet."""
    out, alone = [], np.arange(len(fps))
    while len(alone):
        queue, group, alone = [alone[0]], [], alone[1:]
        while queue and len(alone):
            x = queue.pop()
            group.append(x)
            hit = np.bitwise_count(fps[alone] ^ fps[x]) <= distance
            hit &= own[alone] | own[x]
            queue.extend(alone[hit].tolist())
            alone = alone[~hit]
        group += queue
        if len(group) > 1:
            out.append(np.sort(np.array(group, np.int64)) + offset)
    return out


def groups_of(nodes: DataFrame, layout: list[tuple[list[int], int]], distance: int) -> DataFrame:
    """(group, node): nodes that hang together in a bucket; equal groups of several buckets have one name."""

    def run(batches):
        parts = [(b.column("bucket").to_numpy(), b.column("own").to_numpy(zero_copy_only=False), b.column("fp").to_numpy().view(np.uint64), b.column("node").to_numpy()) for b in batches]
        found: dict[int, np.ndarray] = {}
        if parts:
            bucket, own, fps, node = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((node, ~own, bucket))
            bucket, own, fps, node = bucket[order], own[order], fps[order], node[order]
            cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            for g in found_groups(own, fps, cuts, distance):
                members = np.unique(node[g])
                if len(members) > 1:
                    found[xxhash.xxh64_intdigest(members.tobytes()) >> 1] = members
        names = np.repeat(np.fromiter(found, np.int64, len(found)), [len(x) for x in found.values()])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([np.zeros(0, np.int64), *found.values()]))], ["group", "node"])

    return bucket_rows(nodes, layout).repartition("bucket").mapInArrow(run, "group bigint, node bigint")


def judged(members: DataFrame, most: int) -> DataFrame:
    """(u, v): minimal spanning forests of the links of each group whose wide fingerprints differ in so many bits at most."""

    def forest_of(node: np.ndarray, wide: np.ndarray) -> list[tuple[int, int]]:
        out, rest, at = [], np.arange(1, len(node)), 0
        best, near = np.full(len(node), BITS * WIDE + 1), np.zeros(len(node), np.int64)
        while len(rest):
            d = np.bitwise_count(wide[rest] ^ wide[at]).sum(1, dtype=np.int64)
            closer = d < best[rest]
            best[rest[closer]], near[rest[closer]] = d[closer], at
            k = int(np.argmin(best[rest]))
            at = int(rest[k])
            rest = np.delete(rest, k)
            if best[at] <= most:
                out.append((int(node[near[at]]), int(node[at])))
        return out

    def run(batches):
        now, held = None, []
        for b in batches:
            name, node = b.column("group").to_numpy(), b.column("node").to_numpy()
            wide = np.column_stack([b.column(f"w{k}").to_numpy().view(np.uint64) for k in range(WIDE)])
            cuts = np.concatenate([[0], np.flatnonzero(name[1:] != name[:-1]) + 1, [len(name)]]) if len(name) else np.zeros(1, int)
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if name[a] != now:
                    yield edges(held)
                    now, held = name[a], []
                held.append((node[a:z], wide[a:z]))
        yield edges(held)

    def edges(held):
        found = forest_of(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else []
        e = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])

    return members.repartition("group").sortWithinPartitions("group").mapInArrow(run, "u bigint, v bigint")


def text_nodes(rows: DataFrame) -> DataFrame:
    """node, key, least (doc_id), n (rows of that doc_id), f0.. and w0..: a row for each different text. rows: _id, _key, text."""
    names = [*(f"f{k}" for k in range(FINDERS)), *(f"w{k}" for k in range(WIDE))]

    def run(batches):
        for b in slices(batches):
            made = np.array([wide_fingerprint(x) for x in texts(b)], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_key"), *(pa.array(np.ascontiguousarray(made[:, k])) for k in range(len(names)))], ["_id", "_key", *names])

    fps = rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, _key string, " + ", ".join(f"{c} bigint" for c in names))
    of_id = fps.groupBy("_key", "_id").agg(F.count(F.lit(1)).alias("n"), *(F.max(c).alias(c) for c in names))
    least = F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("least"), F.col("n"))).alias("m")
    nodes = of_id.groupBy(F.col("_key").alias("key")).agg(least, *(F.max(c).alias(c) for c in names))
    return materialise(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "m.least", "m.n", *names))


def jaccard(a: bytes, b: bytes) -> float:
    """Of the sets of five-word shingles; two texts without words are alike."""
    x, y = ({b" ".join(w[k : k + JUDGE]) for k in range(max(1, len(w) - JUDGE + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def confirmed(edges: DataFrame, nodes: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The edges whose texts have that similarity. Only texts of nodes with edges are dealt out."""

    def run(batches):
        before, text = None, b""
        for b in batches:
            out = []
            for u, v, t in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), texts(b), strict=True):
                if (u, v) == before and jaccard(text, t) >= similarity:
                    out.append((u, v))
                before, text = (u, v), t
            e = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])

    pairs = materialise(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    ends = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("node"))
    some = ends.select("node").distinct().join(nodes.select("node", "key", "least"), "node")
    bodies = rows.join(some, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("least"))).groupBy("node").agg(F.first("text").alias("text"))
    return ends.join(bodies, "node").select("u", "v", "text").repartition("u", "v").sortWithinPartitions("u", "v").mapInArrow(run, "u bigint, v bigint")


def near_copies(nodes: DataFrame, rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the nodes of text_nodes(rows) that have links."""
    found = []
    for k in range(FINDERS):
        mine = nodes.select("node", F.col(f"f{k}").alias("fp"))
        found.append(groups_of(mine, plan(mine, FIND_DISTANCE), FIND_DISTANCE))
    members = materialise(reduce(DataFrame.unionByName, found).distinct())
    wide = nodes.select("node", *(f"w{k}" for k in range(WIDE)))
    likely = judged(members.join(wide, "node"), most_bits(similarity - ROOM))
    found = components(confirmed(likely, nodes, rows, similarity))
    discard(members)
    return found


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class of near copies: that of the smallest doc_id (rows without one last), of those with its text one."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.md5(F.coalesce("text", F.lit(""))).alias("_key"), "text")
    mine = rows.select("_id", "_key", "text")
    nodes = text_nodes(mine)
    classes = nodes.join(near_copies(nodes, mine, similarity), "node", "left")
    best = F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "key", "n")).alias("m")
    stays = materialise(classes.groupBy(F.coalesce("component", "node").alias("c")).agg(best).select("m.least", "m.key", "m.n"))
    joined = rows.select("_row", "_id", "_key").join(stays, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("least")))
    kept = joined.where("n = 1").select("_row.*")
    if stays.where("n > 1").limit(1).count():  # repeated rows: only these are grouped
        kept = kept.unionByName(joined.where("n > 1").groupBy("_key", "_id").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*"))
    return kept


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
