"""Ranked lexical search: the highest-scoring documents of each query by windowed bucket scoring.

One pass over the whole texts counts every document's terms and keeps the postings of the queries' terms as a table; its
sums are the corpus statistics. The postings are then laid out by ranges of doc_id, and each task walks its documents in
windows of WINDOW, in the order of doc_id: postings of the window are sorted by term, each query adds up the parts of its
terms in an array that fits the cache, a bitset tells which buckets were touched, and these are harvested into the query's
heap of k. A task hands on at most k rows a query, whose final ranks come from two small windows.

A term is a run of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased. All figures but the
weights' logarithm are integers, so results do not depend on the order of rows. Queries are dealt into blocks of about
ENTRIES terms, which are sent to the tasks; each block walks the texts anew, so a set of queries may have any size.

Null and empty texts have no terms and are in no result. Repeated rows are documents of their own, each with a rank; rows
without doc_id count and come after others of their score. Rows with one id are one query of all their different texts,
null ids too; a query without terms has no rows. Long texts are walked in pieces. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, slices, table, texts

K, WINDOW = 20, 4096
#: Distinct terms of the queries of a block, about; postings of a window, bytes of a piece of a text and postings counted together, at most.
ENTRIES, POSTINGS, PIECE, COUNTED = 100_000, 1 << 20, 1 << 20, 1 << 20
#: Every byte that is in no term becomes a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Groups in which the tasks' rows are ranked before they meet.
SALTS = 64


def term_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and TERM_BYTES[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(TERM_BYTES).split()
        at = end


def query_rows(items: DataFrame, item: str) -> DataFrame:
    """item, term, times: the distinct terms of each query."""

    def run(batches):
        for b in slices(batches):
            ids, terms, times = [], [], []
            for k, raw in enumerate(texts(b)):
                seen = Counter(x for part in term_lists(raw) for x in part)
                ids += [k] * len(seen)
                terms += seen.keys()
                times += seen.values()
            yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(ids, pa.int64())), pa.array(terms, pa.binary()), pa.array(times, pa.int64())], ["item", "term", "times"])

    once = items.select(F.col(item).alias("item"), "text").distinct()
    return once.mapInArrow(run, f"item {dict(once.dtypes)['item']}, term binary, times bigint").groupBy("item", "term").agg(F.sum("times").alias("times"))


def posting_rows(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """id, n (all terms of the document, with repeats), terms (numbers of known ones, ascending), tfs: a row a document."""

    def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(keys, return_inverse=True)
        return found, np.bincount(at, times, len(found)).astype(np.int64)

    def run(batches):
        size = np.int64(max(1, len(ids)))
        for b in slices(batches):
            n, held, keys, times = np.zeros(b.num_rows, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
            for k, raw in enumerate(texts(b)):
                for part in term_lists(raw):
                    n[k] += len(part)
                    known = np.fromiter(map(ids.get, part, repeat(-1)), np.int64, len(part))
                    held.append(known[known >= 0] + k * size)
                    if sum(map(len, held[-64:])) > COUNTED:
                        more = np.concatenate(held)
                        keys, times = summed(np.concatenate([keys, more]), np.concatenate([times, np.ones(len(more), np.int64)]))
                        held = []
            more = np.concatenate([np.zeros(0, np.int64), *held])
            keys, times = summed(np.concatenate([keys, more]), np.concatenate([times, np.ones(len(more), np.int64)]))
            cuts = pa.array(np.searchsorted(keys, np.arange(b.num_rows + 1) * size), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in ((keys % size).astype(np.int32), times)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), *lists], ["id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n bigint, terms array<int>, tfs array<bigint>")


def document_frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of size terms."""

    def run(batches):
        count = np.zeros(size, np.int64)
        for b in batches:
            count += np.bincount(b.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in postings.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the block
        out[r["term"]] = r["df"]
    return out


class Scorer:
    """Scores windows of documents against a block of queries and holds each query's heap."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, size: int):
        self.queries, self.weights, self.n_docs, self.n_terms, self.k, self.size = queries, weights, n_docs, n_terms, k, size
        self.heaps: list[list[tuple]] = [[] for _ in queries]
        self.buckets = np.zeros(size, np.int64)

    def window(self, ids: list, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, doc: np.ndarray) -> None:
        """ids, n of the documents; terms, tfs, doc (place in the window) of all their postings."""
        if 25 * int(n.max(initial=0)) * self.n_docs >= 1 << 63:
            n = n.astype(object)
        m = (75 + 25 * n * self.n_docs // self.n_terms).astype(np.int64)
        order = np.argsort(terms, kind="stable")
        terms, tfs, doc = terms[order], tfs[order], doc[order]
        parts = self.weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 12 * m[doc]))
        present, starts = np.unique(terms, return_index=True)
        ends = np.append(starts[1:], len(terms))
        place = np.full(len(self.weights), -1)
        place[present] = np.arange(len(present))
        bits = np.zeros((len(present), -(-self.size // 64)), np.uint64)
        np.bitwise_or.at(bits, (place[terms], doc >> 6), np.uint64(1) << (doc & 63).astype(np.uint64))
        for (own, times), heap in zip(self.queries, self.heaps, strict=True):
            at = place[own]
            there = at >= 0
            if not there.any():
                continue
            at = at[there]
            for p, c in zip(at.tolist(), times[there].tolist(), strict=True):
                a, z = starts[p], ends[p]
                self.buckets[doc[a:z]] += parts[a:z] * c
            touched = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[at], axis=0).view(np.uint8), bitorder="little"))
            scores = self.buckets[touched]
            self.buckets[touched] = 0
            least = max(1, heap[0][0] if len(heap) == self.k else 1)
            good = np.flatnonzero(scores >= least)
            for d, s in zip(touched[good].tolist(), scores[good].tolist(), strict=True):
                entry = (s, ids[d] is not None, -(ids[d] or 0))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)


def scored(postings: DataFrame, make: Scorer, item_of: list, item_kind: str) -> DataFrame:
    """q, id, score: at most k rows a query and task. postings are sorted by id in each task."""
    kind = dict(postings.dtypes)["id"]

    def run(batches):
        held: list[tuple] = []
        for b in slices(batches, make.size):
            lists = b.column("terms")
            cuts = lists.offsets.to_numpy().astype(np.int64)
            terms, tfs = (b.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
            cuts, ids, n, a = cuts - cuts[0], b.column("id").to_pylist(), b.column("n").to_numpy(), 0
            while a < len(ids):  # windows are cut where their postings are too many, too
                room = make.size - sum(len(x[0]) for x in held)
                z = min(a + room, max(a + 1, int(np.searchsorted(cuts, cuts[a] + POSTINGS, "right")) - 1), len(ids))
                held.append((ids[a:z], n[a:z], terms[cuts[a] : cuts[z]], tfs[cuts[a] : cuts[z]], np.diff(cuts[a : z + 1])))
                if z - a == room or sum(len(x[2]) for x in held) >= POSTINGS:
                    walk(held)
                    held = []
                a = z
        walk(held)
        rows = [(q, -entry[2] if entry[1] else None, entry[0]) for q, heap in enumerate(make.heaps) for entry in heap]
        q, ids, scores = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["q", "id", "score"])

    def walk(held):
        if held:
            sizes = np.concatenate([x[4] for x in held])
            make.window([i for x in held for i in x[0]], *(np.concatenate([x[k] for x in held]) for k in (1, 2, 3)), np.repeat(np.arange(len(sizes)), sizes))

    found = postings.select(F.col("id").cast("bigint").alias("id"), "n", "terms", "tfs").mapInArrow(run, "q int, id bigint, score bigint")
    names = F.array(*(F.lit(x) for x in item_of)).cast(f"array<{item_kind}>")
    return found.select(names[F.col("q")].alias("item"), F.col("id").cast(kind).alias("id"), "score")


def block_results(docs: DataFrame, block: DataFrame, k: int, window: int) -> DataFrame:
    """item, id, score: each task's best of a block of queries (item, term, times), whose rows are read to the driver."""
    rows = block.collect()  # about ENTRIES rows
    ids = {t: j for j, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
    by_item: dict = {}
    for r in rows:
        by_item.setdefault(r["item"], []).append((ids[bytes(r["term"])], r["times"]))
    stored = materialise(posting_rows(docs, ids))
    n_docs, n_terms = stored.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    df = document_frequencies(stored, len(ids))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    queries = [tuple(np.array(x, np.int64) for x in zip(*sorted(found), strict=True)) for found in by_item.values()]
    # Equal doc_ids, however many, go to several tasks by the salt.
    some = stored.where(F.size("terms") > 0).withColumn("_salt", F.monotonically_increasing_id())
    ranged = some.repartitionByRange("id", "_salt").sortWithinPartitions("id", "_salt")
    out = materialise(scored(ranged, Scorer(queries, weights, n_docs, n_terms or 1, k, window), list(by_item), dict(block.dtypes)["item"]))
    discard(stored)
    return out


def search(docs: DataFrame, items: DataFrame, doc_id: str, item: str, k: int = K, window: int = WINDOW, entries: int = ENTRIES) -> DataFrame:
    """item, rank, id, score: the k highest-scoring documents (doc_id, text) of each query (item, text)."""
    few = docs.select(F.col(doc_id).alias("id"), "text")
    stored = materialise(query_rows(items, item))
    blocks = max(1, math.ceil(stored.count() / entries))
    dealt = stored.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    found = reduce(DataFrame.unionByName, [block_results(few, dealt.where(F.col("block") == b), k, window) for b in range(blocks)])
    discard(stored)
    by = [F.desc("score"), F.asc_nulls_last("id")]
    for keys in (["item", F.pmod(F.spark_partition_id(), F.lit(SALTS))], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= k)
    return found.select("item", "rank", "id", "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), docs AS (
  SELECT r, doc_id, ts, len(ts)::BIGINT AS n FROM words WHERE len(ts) > 0
), whole AS (
  SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM docs
), items AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)
  ) GROUP BY ALL
), tfs AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term
), scores AS (
  SELECT i.item_id, t.r, t.doc_id, sum(i.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (100 - 25 + (25 * t.n * nd) // nt))))::BIGINT AS score
  FROM items i JOIN tfs t USING (term) JOIN weights w USING (term), whole GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
) WHERE rank <= 20
"""
