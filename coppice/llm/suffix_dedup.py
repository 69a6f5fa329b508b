"""Suffix-array dedup: removes the bytes of 50-byte strings that also start in a document with a smaller doc_id.

How equal strings of different documents meet: in every 50-byte string the smallest hash among its GRAM-byte strings is
its anchor, so equal strings have equal anchors at equal places. (1) Anchor hashes of all documents are dealt out by
hash and those that stand in two documents or more go back to the blocks of documents that have them. (2) The
surroundings of these anchors (all 50-byte strings around them) are dealt out by the same hash; each shard sorts the
suffixes of its distinct surroundings by external induced sorting with common-prefix values, runs of suffixes with 50
places in common are equal strings, and the least doc_id of each run decides for every surrounding and place. (3) The
places go back to their documents, where runs of removed bytes are cut out.

Rows on the way are packed, compressed blobs, a few for each pair of block and shard: equal surroundings of one block
are one entry with its least doc_id, so a passage that a third of all documents share reaches its shard once a block
with its list of places. Blocks and shards are sized by the total of bytes. A task that is lost is computed again
from its input; the sorter's scratch files are its own and go with it.

Null texts are empty. Texts of less than 50 bytes lose nothing. Rows without doc_id take no part and lose nothing.
Rows with the same doc_id are separate rows, and none of them is before another. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_for, slices, table, text_bytes
from .induced import DEPTH, suffixes

GRAM = 20
#: GRAM-byte strings in a string of DEPTH bytes, and bytes of a surrounding.
STARTS = DEPTH - GRAM + 1
BEFORE = DEPTH - GRAM
AROUND = BEFORE + DEPTH
ROW = AROUND + 2
PAD = 255
#: Text bytes of a block of documents, and of the documents whose anchors make a shard.
BLOCK_BYTES, SHARD_BYTES = 24 << 20, 6 << 20
#: A shard's number has 24 bits of an anchor's hash: enough for 100 TB in shards of SHARD_BYTES; beyond, shards grow.
MOST_SHARDS = 1 << 24
#: Anchors whose surroundings are laid out together.
ANCHORS_AT_ONCE = 1 << 17
#: Bytes looked at together.
SEGMENT = 4 << 20
LOW = np.uint64((1 << 40) - 1)
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
BLOB = "kind int, key bigint, sub int, blob binary"


def pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts))


def unpack(blob: bytes, *kinds: str) -> list:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8 * len(kinds)
    for size, kind in zip(struct.unpack(f"<{len(kinds)}q", raw[:at]), kinds, strict=True):
        part = raw[at : at + size]
        out.append(part if kind == "bytes" else np.frombuffer(part, kind))
        at += size
    return out


def low_bytes(h: np.ndarray) -> np.ndarray:
    """The low 40 bits of each hash, five bytes a hash, as columns."""
    return np.ascontiguousarray((h & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T)


def from_low_bytes(raw: np.ndarray) -> np.ndarray:
    cols = raw.reshape(5, -1)
    out = np.zeros((cols.shape[1], 8), np.uint8)
    out[:, :5] = cols.T
    return out.view("<u8").ravel().astype(np.uint64)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every width neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that lie one after another and end at ends."""
    found, hashes = [], []
    n = len(data)
    margin = 2 * DEPTH
    for start in range(0, n, SEGMENT):
        low, high = max(0, start - margin), min(n, start + SEGMENT + margin)
        if high - low < GRAM:
            continue
        part = np.concatenate([data[low:high], np.zeros(8, np.uint8)])
        words = np.ndarray((high - low,), "<u8", part.data, strides=(1,))
        m = high - low - GRAM + 1
        h = words[:m].astype(np.uint64) * K1
        h ^= h >> np.uint64(32)
        h += words[8 : 8 + m]
        h *= K2
        h ^= h >> np.uint64(29)
        h += words[GRAM - 8 : GRAM - 8 + m]
        h *= K3
        h ^= h >> np.uint64(32)
        cut = ends[(ends > low) & (ends < high)] - low
        for k in range(1, GRAM):  # no string over the end of a text
            at = cut - k
            h[at[(at >= 0) & (at < m)]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        if m < STARTS:
            continue
        least = sliding(h, STARTS, np.minimum)
        pad = np.zeros(STARTS - 1, np.uint64)
        most = sliding(np.concatenate([pad, least, pad]), STARTS, np.maximum)
        chosen = np.flatnonzero((most == h) & (h != np.uint64(0xFFFFFFFFFFFFFFFF)))
        chosen = chosen[(chosen + low >= start) & (chosen + low < start + SEGMENT)]
        found.append(chosen + low)
        hashes.append(h[chosen])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(found), np.concatenate(hashes)


class Texts:
    """Documents one after another."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids = ids
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, hash and document of each anchor."""
        at, h = anchors(self.data, self.ends)
        return at, h, np.searchsorted(self.ends, at, "right")


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc_id, known, texts) of documents with about so many bytes."""
    ids, known, texts, size = [], [], [], 0
    for b in slices(batches, 256):
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True):
            t = t.as_py() or b""
            ids.append(-1 if i is None else i)
            known.append(i is not None)
            texts.append(t)
            size += len(t)
            if size >= most:
                yield np.array(ids, np.int64), np.array(known, bool), texts
                ids, known, texts, size = [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(known, bool), texts


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * K1
    return ((x ^ x >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def rows(made: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*made, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["kind", "key", "sub", "blob"])


def groups(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else []
    for a, z in zip(cuts, [*cuts[1:], len(key)], strict=True):
        yield int(key[order[a]]), order[a:z]


def packed_texts(docs: DataFrame, blocks: int) -> DataFrame:
    """Kind 1: (block, documents)."""

    def run(batches):
        for ids, known, texts in gathered(batches, 2 * SEGMENT):
            for block, at in groups(np.where(known, block_of(ids, blocks), 0)):
                part = [texts[i] for i in at.tolist()]
                sizes = np.fromiter(map(len, part), np.int64, len(part))
                yield rows([(1, block, 0, pack(ids[at], known[at], sizes, b"".join(part)))])

    return docs.select("doc_id", "text").mapInArrow(run, BLOB)


def anchor_hashes(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, documents and their hashes), a hash once a document."""

    def run(batches):
        for ids, known, texts in gathered(batches, 2 * SEGMENT):
            t = Texts(ids, texts)
            _, h, doc = t.anchors()
            use = known[doc]
            h, doc = h[use], ids[doc[use]]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            once = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
            h, doc = h[once], doc[once]
            made = []
            for shard, at in groups(((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)):
                d, counts = np.unique(doc[at], return_counts=True)
                made.append((0, shard, 0, pack(np.diff(d, prepend=0), counts.astype(np.uint32), low_bytes(h[at]))))
            yield rows(made)

    return docs.select("doc_id", "text").mapInArrow(run, BLOB)


def shared_hashes(hashes: DataFrame, shards: int, blocks: int) -> DataFrame:
    """Kind 0: (block, shard, hashes of the block's documents that stand in two documents or more)."""

    def shard_rows(shard: int, blobs: list[bytes]) -> list[tuple[int, int, int, bytes]]:
        h, doc = [], []
        for blob in blobs:
            d, counts, raw = unpack(blob, "<i8", "<u4", "u1")
            h.append(from_low_bytes(raw))
            doc.append(np.repeat(np.cumsum(d), counts))
        h, doc = np.concatenate(h), np.concatenate(doc)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        shared = (np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first))[group]
        h, block = h[shared], block_of(doc[shared], blocks)
        return [(0, b, shard, pack(low_bytes(np.unique(h[at])))) for b, at in groups(block)]

    def run(batches):
        for shard, blobs in by_key(batches):
            if made := shard_rows(shard, [x for _, _, x in blobs]):
                yield rows(made)

    return hashes.repartition("key").sortWithinPartitions("key").mapInArrow(run, BLOB)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(key, rows) of batches sorted by key."""
    now, held = None, []
    for b in batches:
        for kind, key, sub, blob in zip(*(b.column(c).to_pylist() for c in ("kind", "key", "sub", "blob")), strict=True):
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append((kind, sub, blob))
    if held:
        yield now, held


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("kind", "key", "sub", "blob")), strict=True)


def surroundings(t: Texts, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A row for each anchor: first and last valid place, then the AROUND bytes around it."""
    out = np.full((len(at), ROW), PAD, np.uint8)
    low = np.maximum(t.starts[doc] - at, -BEFORE) + BEFORE
    high = np.minimum(t.ends[doc] - at, DEPTH) + BEFORE
    out[:, 0], out[:, 1] = low, high
    for k in range(AROUND):
        inside = (k >= low) & (k < high)
        out[inside, 2 + k] = t.data[at[inside] + k - BEFORE]
    return out


def distinct(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of one row of each kind, and for every row which of these it is. Rows, not only hashes, are compared."""
    wide = np.zeros((len(found), -(-ROW // 8) * 8), np.uint8)
    wide[:, :ROW] = found
    words = wide.view("<u8")
    h = np.zeros(len(found), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * K1
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        near = np.flatnonzero(h[order][1:] == h[order][:-1])
        new[near + 1] = (words[order[near]] != words[order[near + 1]]).any(1)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def distinct_surroundings(t: Texts, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different surroundings of anchors, and for every anchor which of these it has. Laid out in parts: in a run of one character every place is an anchor."""
    parts, of, n = [np.zeros((0, ROW), np.uint8)], [np.zeros(0, np.int64)], 0
    for k in range(0, len(at), ANCHORS_AT_ONCE):
        found = surroundings(t, at[k : k + ANCHORS_AT_ONCE], doc[k : k + ANCHORS_AT_ONCE])
        first, which = distinct(found)
        parts.append(found[first])
        of.append(which + n)
        n += len(first)
    every = np.concatenate(parts)
    first, same = distinct(every)
    return every[first], same[np.concatenate(of)]


def shared_surroundings(joined: DataFrame, shards: int) -> DataFrame:
    """(shard, distinct surroundings of a block with least doc_id, and where they stand)."""

    def block_rows(t: Texts, wanted: np.ndarray) -> list[tuple[int, int, int, bytes]]:
        at, h, doc = t.anchors()
        shard = ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
        name = (shard.astype(np.uint64) << np.uint64(40)) | (h & LOW)
        use = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, name), len(wanted) - 1)] == name)
        made = []
        for s, k in groups(shard[use]):
            k = use[k]
            found, which = distinct_surroundings(t, at[k], doc[k])
            ids = t.ids[doc[k]]
            order = np.lexsort((at[k], ids))
            place = (at[k] - t.starts[doc[k]])[order]
            made.append((0, s, 0, pack(found.T, np.diff(ids[order], prepend=0), place, which[order].astype(np.uint32))))
        return made

    def run(batches):
        now, wanted, parts = None, [], None

        def flush(texts):
            if parts and texts:
                ids, known = np.concatenate([x[0] for x in texts]), np.concatenate([x[1] for x in texts])
                every = [b for x in texts for b in x[2]]
                use = np.flatnonzero(known)
                yield rows(block_rows(Texts(ids[use], [every[i] for i in use.tolist()]), wanted))

        texts, size = [], 0
        for kind, key, sub, blob in streamed(batches):
            if key != now:
                yield from flush(texts)
                now, wanted, parts, texts, size = key, None, [], [], 0
            if kind == 0:
                parts.append(np.uint64(sub << 40) | from_low_bytes(unpack(blob, "u1")[0]))
                continue
            if wanted is None:
                wanted = np.sort(np.concatenate(parts)) if parts else None
            if wanted is None:
                continue
            ids, known, sizes, raw = unpack(blob, "<i8", "?", "<i8", "bytes")
            ends = np.cumsum(sizes)
            texts.append((ids, known, [raw[a:z] for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]))
            size += len(raw)
            if size >= BLOCK_BYTES // 3:
                yield from flush(texts)
                texts, size = [], 0
        yield from flush(texts)

    return joined.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(run, BLOB)


def least_documents(found: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every surrounding and place in it, the least document in which the string of DEPTH bytes there begins."""
    n, width = len(found), AROUND + 1
    out = np.repeat(least[:, None], AROUND - DEPTH + 1, 1)
    if not n:
        return out
    data = np.full((n, width), PAD, np.uint8)
    data[:, :AROUND] = found[:, 2:]
    for held_pos, run_ids in equal_runs(data.ravel()):
        of, place = held_pos // width, held_pos % width
        valid = (place <= AROUND - DEPTH) & (place >= found[of, 0]) & (place + DEPTH <= found[of, 1])
        of, place, run = of[valid], place[valid], run_ids[valid]
        if not len(of):
            continue
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        lowest = np.minimum.reduceat(least[of], first)
        out[of, place] = np.repeat(lowest, np.diff(np.append(first, len(run))))
    return out


def equal_runs(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes in order with the number of their run of equal first DEPTH places; runs of one are left out, none is parted."""
    carry = np.zeros(0, np.int64)
    for pos, lcp in suffixes(data):
        new = lcp < DEPTH
        if not new.any():
            carry = np.concatenate([carry, pos])
            continue
        starts = np.flatnonzero(new)
        head, tail = int(starts[0]), int(starts[-1])
        whole = np.concatenate([carry, pos[:tail]])
        run = np.concatenate([np.zeros(len(carry) + head, np.int64), np.cumsum(new)[head:tail]])
        yield several(whole, run)
        carry = pos[tail:].copy()
    yield several(carry, np.zeros(len(carry), np.int64))


def several(pos: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.bincount(run, minlength=1) if len(run) else np.zeros(1, np.int64)
    keep = sizes[run] > 1 if len(run) else np.zeros(0, bool)
    return pos[keep], run[keep]


def removed_places(found: DataFrame, blocks: int) -> DataFrame:
    """Kind 0: (block, documents, places of anchors, which strings around them go)."""

    def shard_rows(blobs: list[bytes]) -> list[tuple[int, int, int, bytes]]:
        rows_of, ids, place, which, n = [], [], [], [], 0
        for blob in blobs:
            f, d, p, w = unpack(blob, "u1", "<i8", "<i8", "<u4")
            rows_of.append(np.ascontiguousarray(f.reshape(ROW, -1).T))
            ids.append(np.cumsum(d))
            place.append(p)
            which.append(w.astype(np.int64) + n)
            n += len(rows_of[-1])
        every = np.concatenate(rows_of)
        first, same = distinct(every)
        ids, place, which = np.concatenate(ids), np.concatenate(place), same[np.concatenate(which)]
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids)
        kept = every[first]
        del every, rows_of
        table_of = least_documents(kept, least)
        bits = np.uint32(1) << np.arange(AROUND - DEPTH + 1, dtype=np.uint32)
        places = np.arange(AROUND - DEPTH + 1)
        made, block = [], block_of(ids, blocks)
        for b, at in groups(block):
            mask = np.zeros(len(at), np.uint32)
            for k in range(0, len(at), 1 << 18):
                part = at[k : k + (1 << 18)]
                w = which[part]
                goes = (table_of[w] < ids[part][:, None]) & (places >= kept[w, 0][:, None]) & (places + DEPTH <= kept[w, 1][:, None])
                mask[k : k + len(part)] = (goes * bits).sum(1, dtype=np.uint32)
            at, mask = at[mask > 0], mask[mask > 0]
            if len(at):
                order = np.lexsort((place[at], ids[at]))
                made.append((0, b, 0, pack(np.diff(ids[at][order], prepend=0), place[at][order], mask[order])))
        return made

    def run(batches):
        for _, blobs in by_key(batches):
            if made := shard_rows([x for _, _, x in blobs]):
                yield rows(made)

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, BLOB)


def cut(text: bytes, starts: np.ndarray) -> tuple[bytes, int, int]:
    """What is left without the strings of DEPTH bytes at these sorted places, bytes removed, runs removed."""
    if not len(starts):
        return text, 0, 0
    apart = np.flatnonzero(np.append(True, starts[1:] > starts[:-1] + DEPTH))
    begin, end = starts[apart], np.append(starts[apart[1:] - 1], starts[-1]) + DEPTH
    left, at = [], 0
    for a, z in zip(begin.tolist(), end.tolist(), strict=True):
        left.append(text[at:a])
        at = z
    left.append(text[at:])
    return b"".join(left), int((end - begin).sum()), len(apart)


def remaining(joined: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that are left) of every document."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text

    def run(batches):
        now, parts, held = None, [], None
        for kind, key, _, blob in streamed(batches):
            if key != now:
                now, parts, held = key, [], None
            if kind == 0:
                parts.append(unpack(blob, "<i8", "<i8", "<u4"))
                continue
            if held is None:
                ids = np.concatenate([np.cumsum(x[0]) for x in parts]) if parts else np.zeros(0, np.int64)
                order = np.argsort(ids, kind="stable")
                held = (ids[order], np.concatenate([x[1] for x in parts])[order], np.concatenate([x[2] for x in parts])[order]) if parts else (ids, ids, ids.astype(np.uint32))
                parts = []
            ids, known, sizes, raw = unpack(blob, "<i8", "?", "<i8", "bytes")
            ends = np.cumsum(sizes)
            low, high = np.searchsorted(held[0], ids, "left"), np.searchsorted(held[0], ids, "right")
            made = []
            for i, ok, a, z, x, y in zip(ids.tolist(), known.tolist(), (ends - sizes).tolist(), ends.tolist(), low.tolist(), high.tolist(), strict=True):
                text, starts = raw[a:z], np.zeros(0, np.int64)
                if ok and y > x:
                    bits = (held[2][x:y, None] >> np.arange(AROUND - DEPTH + 1, dtype=np.uint32)) & np.uint32(1)
                    row, col = np.nonzero(bits)
                    starts = np.unique(held[1][x:y][row] - BEFORE + col)
                    starts = starts[(starts >= 0) & (starts + DEPTH <= len(text))]
                left, gone, spans = cut(text, starts)
                made.append((i if ok else None, len(text), gone, spans, hashlib.sha256(left).hexdigest(), *[left] * with_text))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names)

    return joined.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)


def suffix_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """What is left of every document; see the module's docstring."""
    total = text_bytes(docs)
    blocks, shards = blocks_for(total, BLOCK_BYTES), min(MOST_SHARDS, blocks_for(total, SHARD_BYTES))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    packed = packed_texts(docs, blocks)
    wanted = shared_hashes(anchor_hashes(docs, shards), shards, blocks)
    found = shared_surroundings(wanted.unionByName(packed), shards)
    return remaining(removed_places(found, blocks).unionByName(packed), with_text)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


#: The same in DuckDB: every 50-byte string of every document, as hex.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM d, LATERAL (SELECT unnest(range(greatest(0, length(h) // 2 - 49))) AS k)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
r AS (SELECT doc_id, k FROM w JOIN m USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS fresh FROM r),
n AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM g),
runs AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS z FROM n GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM runs
  UNION ALL SELECT d.doc_id, coalesce(max(z), 0), length(any_value(h)) // 2 FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id
),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS left_over FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(left_over)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
