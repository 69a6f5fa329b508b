"""External induced sorting of suffixes with common-prefix values, in numpy.

Suffix tuples (position, common prefix with the tuple before it in its bucket) wait in a disk-backed bucket queue: a
monotone priority queue whose key is the first byte and, within it, the order of arrival. Popping the least bucket
induces the suffixes one place to the left into later buckets; ranges of common-prefix values give the value of each
new tuple. A first pass induces the L-type suffixes from the sorted seeds (leftmost S-type suffixes), a second one, from
the other end, the S-type suffixes from those. The seeds are sorted through their names: seed substrings are named and
the string of names, the reduced problem, is sorted by doubling.

Order and common-prefix values hold up to DEPTH places, which is all that is asked of them: doubling ends when that
many places are told apart.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

DEPTH = 50
#: Tuples popped at once, and tuples that wait in memory before all go to disk.
CHUNK, IN_MEMORY = 1 << 20, 1 << 23
FAR = 255
SYMBOLS = 257


def position_type(n: int) -> type:
    """Positions of a shard of n bytes: 32 bits where they do."""
    return np.int32 if n < MOST_SHORT else np.int64


#: Bytes from which positions have 64 bits.
MOST_SHORT = (1 << 31) - 128


def scratch_folder() -> str | None:
    """A folder of Spark's own for scratch, on the disks that are meant for it; the system's where Spark names none."""
    named = ",".join(os.environ.get(x, "") for x in ("SPARK_EXECUTOR_DIRS", "LOCAL_DIRS", "SPARK_LOCAL_DIRS"))
    return next((x for x in named.split(",") if x and os.path.isdir(x) and os.access(x, os.W_OK)), None)


class BucketQueue:
    """Tuples by bucket, in order of arrival; spilled to one file a bucket when too many wait."""

    def __init__(self, folder: str, in_memory: int, kind: type):
        self.folder, self.in_memory, self.waiting, self.kind = folder, in_memory, 0, kind
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.on_disk: set[int] = set()

    def push(self, bucket: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.setdefault(bucket, []).append((pos, lcp))
        self.waiting += len(pos)
        if self.waiting > self.in_memory:
            for b, parts in self.parts.items():
                for suffix, k in (("pos", 0), ("lcp", 1)):
                    with open(f"{self.folder}/{b}.{suffix}", "ab") as f:
                        for x in parts:
                            x[k].tofile(f)
                self.on_disk.add(b)
            self.parts, self.waiting = {}, 0

    def pop(self, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a bucket, in chunks; what is pushed to it meanwhile comes after."""
        while bucket in self.on_disk or bucket in self.parts:
            if bucket in self.on_disk:
                self.on_disk.discard(bucket)
                names = [f"{self.folder}/{bucket}.{x}" for x in ("pos", "lcp")]
                moved = [f"{n}.read" for n in names]
                for n, m in zip(names, moved, strict=True):
                    os.replace(n, m)
                with open(moved[0], "rb") as p, open(moved[1], "rb") as q:
                    while len(pos := np.fromfile(p, self.kind, CHUNK)):
                        yield pos, np.fromfile(q, np.uint8, CHUNK)
                for m in moved:
                    os.remove(m)
                continue
            parts = self.parts.pop(bucket)
            pos, lcp = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
            self.waiting -= len(pos)
            for k in range(0, len(pos), CHUNK):
                yield pos[k : k + CHUNK], lcp[k : k + CHUNK]


class Inducer:
    """Keeps, for each bucket, the least common prefix seen since the last push to it."""

    def __init__(self, queue: BucketQueue):
        self.queue = queue
        self.pending = np.full(SYMBOLS, FAR, np.uint8)
        self.pushed = np.zeros(SYMBOLS, bool)

    def feed(self, pos: np.ndarray, lcp: np.ndarray, induced: np.ndarray, target: np.ndarray) -> None:
        """Scanned tuples in order, lcp with the one scanned before; those induced push pos - 1 to bucket target."""
        n = len(pos)
        if not n:
            return
        at = np.flatnonzero(induced)
        before, was = self.pending, self.pushed.copy()
        self.pending = np.minimum(before, lcp.min())
        if not len(at):
            return
        to = target[at]
        order = np.argsort(to, kind="stable")
        r, to = at[order], to[order]
        value = np.empty(len(r), np.uint8)
        same = np.zeros(len(r), bool)
        same[1:] = to[1:] == to[:-1]
        first = np.flatnonzero(~same)
        d = to[first]
        value[first] = np.where(was[d], np.minimum(np.minimum(before[d], minima_up_to(lcp, r[first])), DEPTH - 1) + 1, 0)
        later = np.flatnonzero(same)
        if len(later):
            a, z = r[later - 1] + 1, r[later]
            value[later] = np.minimum(self._range_min(lcp, a, z), DEPTH - 1) + 1
        ends = np.append(first[1:], len(r))
        self.pending[d] = minima_from(lcp, r[ends - 1] + 1)
        self.pushed[d] = True
        out = pos[r] - 1
        for b, x, y in zip(d.tolist(), first.tolist(), ends.tolist(), strict=True):
            self.queue.push(b, out[x:y], value[x:y])

    @staticmethod
    def _range_min(lcp: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """min(lcp[a..z]) for each a <= z, by a sparse table built as far as it is needed."""
        width = z - a + 1
        level = np.frexp(width.astype(np.float64))[1] - 1
        out, table = np.empty(len(a), np.uint8), lcp
        for k in range(int(level.max()) + 1):
            if k:
                half = 1 << (k - 1)
                table = np.minimum(table[: len(table) - half], table[half:])
            here = np.flatnonzero(level == k)
            if len(here):
                out[here] = np.minimum(table[a[here]], table[z[here] - (1 << k) + 1])
        return out


def minima_up_to(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """min(x[: k + 1]) for each k of at, which are few and different."""
    order = np.argsort(at)
    k = at[order]
    out = np.empty(len(at), x.dtype)
    out[order] = np.minimum.accumulate(np.minimum.reduceat(x[: k[-1] + 1], np.append(0, k[:-1] + 1)))
    return out


def minima_from(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """min(x[k:]) for each k of at, which are few and different; FAR at the end."""
    out = np.full(len(at), FAR, x.dtype)
    order = np.argsort(at)
    order = order[at[order] < len(x)]
    if len(order):
        out[order] = np.minimum.accumulate(np.minimum.reduceat(x, at[order])[::-1])[::-1]
    return out


def words_at(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as one big-endian number; the text has 64 bytes of padding at its end."""
    return np.ndarray((len(text) - 7,), ">u8", text.data, strides=(1,))


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places, up to DEPTH, that suffixes a and b have in common; the end of the text differs from every byte."""
    out = np.full(len(a), DEPTH, np.int64)
    words, rest = words_at(text), np.arange(len(a))
    for k in range(0, DEPTH, 8):
        x = (words[a[rest] + k] ^ words[b[rest] + k]).astype(np.uint64)
        differ = x != 0
        at = rest[differ]
        y = x[differ]
        guess = np.full(len(y), k)
        for byte in range(1, 8):  # bytes at the front that agree
            guess += y < np.uint64(1 << (64 - 8 * byte))
        out[at] = np.minimum(guess, DEPTH)
        rest = rest[~differ]
        if not len(rest):
            break
    return np.minimum(out, np.minimum(n - a, n - b)).astype(np.uint8)


def regrouped(rank: np.ndarray, rest: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks of rest refined by key; returns those still tied. A rank is the number of seeds before its group."""
    if key.dtype == np.uint64 and rank[rest].any():  # keys by their places in order, so that rank and key are one number
        order = np.argsort(key)
        place = np.empty(len(key), np.int64)
        place[order] = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
        order = np.argsort(rank[rest] * len(key) + place)
    else:
        order = np.argsort(key if key.dtype == np.uint64 else rank[rest] * (len(rank) + 2) + key)
    old, key = rank[rest][order], key[order]
    starts_old = np.append(True, old[1:] != old[:-1])
    starts_new = starts_old | np.append(True, key[1:] != key[:-1])
    first_old, first_new = np.flatnonzero(starts_old), np.flatnonzero(starts_new)
    group = np.cumsum(starts_new) - 1
    at = rest[order]
    rank[at] = old + first_new[group] - first_old[np.cumsum(starts_old) - 1]
    sizes = np.diff(np.append(first_new, len(rest)))
    return np.sort(at[sizes[group] > 1])


def seed_order(text: np.ndarray, n: int, seeds: np.ndarray, s_type: np.ndarray) -> np.ndarray:
    """Seeds sorted by their suffixes up to DEPTH places: named substrings, then doubling on the reduced string."""
    m = len(seeds)
    length = np.append(seeds[1:], n) - seeds + 1
    rank, rest, at = np.zeros(m, np.int64), np.arange(m), 0
    open_seeds, codes = np.ones(m, bool), np.ones(len(text), np.uint16)
    codes[:n] += text[:n]
    codes[:n] += text[:n]
    codes[:n] += s_type[:n]
    # Seven places at a time, each as byte and type, so that no name is a prefix of another. What agrees in DEPTH places may stay tied.
    while len(rest) and at < DEPTH:
        key, size, now = np.zeros(len(rest), np.uint64), length[rest], seeds[rest]
        for k in range(at, at + 7):
            code = codes[now + k]
            code[k >= size] = 0
            key *= np.uint64(513)
            key += code
        tied_now = regrouped(rank, rest, key)
        at += 7
        open_seeds[rest] = False
        open_seeds[tied_now] = True
        rest = tied_now[length[tied_now] > at]
    open_seeds[rest] = False
    tied, step = np.flatnonzero(open_seeds), 1
    while step < DEPTH and len(tied):  # every name spans two places at least
        after = tied + step
        follow = np.where(after < m, rank[np.minimum(after, m - 1)] + 1, 0)
        tied = regrouped(rank, tied, follow)
        step *= 2
    return np.argsort(rank, kind="stable")


def rising(data: np.ndarray) -> np.ndarray:
    """True for S-type places (the suffix is less than the next one), by chunks from the end; the end itself is S-type."""
    n = len(data)
    out = np.empty(n + 1, bool)
    out[n] = True
    after = False  # the last place is L-type: the end is less than every byte
    for z in range(n, 0, -CHUNK):
        a = max(0, z - CHUNK)
        here, nxt = data[a:z], data[a + 1 : z + 1]
        up = np.empty(z - a, bool)
        same = np.zeros(z - a, bool)
        up[: len(nxt)] = here[: len(nxt)] < nxt
        same[: len(nxt)] = here[: len(nxt)] == nxt
        up[len(nxt) :] = False
        known = np.where(same, z - a, np.arange(z - a, dtype=np.int32))
        known = np.minimum.accumulate(known[::-1])[::-1]
        out[a:z] = np.append(up, after)[known]
        after = bool(out[a])
    return out


def suffixes(data: np.ndarray, folder: str | None = None, in_memory: int = IN_MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, in chunks: positions, and the common prefix (up to DEPTH) with the one before."""
    n = len(data)
    if not n:
        return
    kind = position_type(n)
    text = np.concatenate([data, np.zeros(64, np.uint8)])
    s_type = rising(data)
    seeds = np.concatenate([np.flatnonzero(s_type[k + 1 : k + 1 + CHUNK] & ~s_type[k : min(k + CHUNK, n)][: len(s_type[k + 1 : k + 1 + CHUNK])]).astype(kind) + kind(k + 1) for k in range(0, n, CHUNK)])
    seeds = seeds[seeds < n]
    with tempfile.TemporaryDirectory(dir=folder or scratch_folder()) as tmp:
        os.mkdir(f"{tmp}/l"), os.mkdir(f"{tmp}/s"), os.mkdir(f"{tmp}/kept")
        if len(seeds):
            seeds = seeds[seed_order(text, n, seeds, s_type)]
        del s_type
        heads = data[seeds].astype(np.int64)
        seed_lcp = np.append(np.zeros(1, np.uint8), common_prefix(text, seeds[1:], seeds[:-1], n))[: len(seeds)]
        cuts = np.searchsorted(heads, np.arange(SYMBOLS))
        queue, kept = BucketQueue(f"{tmp}/l", in_memory, kind), BucketQueue(f"{tmp}/kept", in_memory, kind)
        inducer = Inducer(queue)

        def previous(pos: np.ndarray) -> np.ndarray:
            return text[np.maximum(pos - 1, 0)].astype(np.int16)

        # The end of the text comes first and induces the last suffix.
        inducer.feed(np.array([n], kind), np.zeros(1, np.uint8), np.array([True]), np.array([int(data[-1])], np.int16))
        for c in range(256):
            last = -1
            for pos, lcp in queue.pop(c):
                kept.push(c, pos, lcp)
                to = previous(pos)
                inducer.feed(pos, lcp, (pos > 0) & (to >= c), to)
                last = int(pos[-1])
            pos = seeds[cuts[c] : cuts[c + 1]]
            for k in range(0, len(pos), CHUNK):
                part, lcp = pos[k : k + CHUNK], seed_lcp[cuts[c] + k : cuts[c] + k + CHUNK].copy()
                if not k:
                    lcp[0] = common_prefix(text, np.array([last], kind), part[:1], n)[0] if last >= 0 else 0
                inducer.feed(part, lcp, np.ones(len(part), bool), previous(part))
        del seeds, seed_lcp, heads
        queue = BucketQueue(f"{tmp}/s", in_memory, kind)
        inducer = Inducer(queue)
        for c in range(255, -1, -1):
            last = -1
            for pos, lcp in queue.pop(c):
                to = previous(pos)
                inducer.feed(pos, lcp, (pos > 0) & (to <= c), to)
                yield pos, lcp
                last = int(pos[-1])
            for pos, lcp in backwards(kept, c):
                if last < 0:
                    lcp[0] = 0
                elif lcp[0] == FAR:
                    lcp[0] = common_prefix(text, np.array([last], kind), pos[:1], n)[0]
                to = previous(pos)
                inducer.feed(pos, lcp, (pos > 0) & (to < c), to)
                yield pos, lcp
                last = int(pos[-1])


def backwards(kept: BucketQueue, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of a finished bucket from its end; lcp becomes that with the tuple given before, FAR where a chunk begins."""
    if bucket in kept.on_disk:
        with open(f"{kept.folder}/{bucket}.pos", "ab") as p, open(f"{kept.folder}/{bucket}.lcp", "ab") as q:
            for pos, lcp in kept.parts.pop(bucket, []):
                kept.waiting -= len(pos)
                pos.tofile(p)
                lcp.tofile(q)
        names = [f"{kept.folder}/{bucket}.{x}" for x in ("pos", "lcp")]
        every, values = np.memmap(names[0], kept.kind, "r"), np.memmap(names[1], np.uint8, "r")
    elif bucket in kept.parts:
        parts = kept.parts.pop(bucket)
        every, values = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        kept.waiting -= len(every)
    else:
        return
    for end in range(len(every), 0, -CHUNK):
        start = max(0, end - CHUNK)
        pos = np.array(every[start:end][::-1])
        lcp = np.empty(len(pos), np.uint8)
        lcp[0] = FAR
        lcp[1:] = values[start + 1 : end][::-1]
        yield pos, lcp
