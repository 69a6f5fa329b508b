"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A text becomes marked words: white space is the mark U+2581, and a unit is a run of marks with the word after it. The
distinct units of a batch are sorted, which lays them out as a trie in depth-first order, and one stack of forward
states walks it: where two units share a prefix, the states of the prefix are reused. A state holds the best last piece
of a prefix. In a unigram vocabulary the best is the highest sum of scores; in a merge (BPE) vocabulary it is the one
piece that may follow the state before it, which gives exactly the merges that SentencePiece makes; there the walk goes
down the trie a level at a time, in arrays over all its prefixes, and one by one where few units are so long. Characters
outside the vocabulary become byte pieces. One map over the documents, no shuffle; encodings are cached within bounds.

Null and empty texts have no pieces. Decoding gives back the text; where SentencePiece's own normalisation would not
(none for this vocabulary), round_trip says so. Texts are never cut. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table
from .piece_levels import Borders, Suffixes

MARK = "▁"
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Entries a cache may hold before it is emptied.
CACHED_UNITS, CACHED_PAIRS = 100_000, 60_000
#: Units this long are not cached.
LONG_UNIT = 64
#: A level of so many units at least is walked in arrays, so many characters at a time.
WIDE, WALKED = 64, 250_000
ROWS = 500
#: Key of a piece's id in the vocabulary's trie, and the mark of a character outside the vocabulary.
END, NONE = "", -1


class Vocabulary:
    """Pieces of a SentencePiece model: merge (BPE) or unigram."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        self.merges = model_type(model) == 2
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        # No piece spans another character, nor a mark after a character: units may end there.
        self.splits_at_marks = not any(MARK in p.lstrip(MARK) for p in self.ids)
        joined = "".join(sorted(inside - {MARK}))
        tail = f"[{re.escape(joined)}]*" if joined else ""
        self.unit = re.compile(f"{MARK}+{tail}|[{re.escape(joined)}]+|." if self.splits_at_marks else f"[{re.escape(joined + MARK)}]+|.", re.S)
        #: Whether units may be split off at spaces and line ends: no piece spans those.
        self.plain = self.splits_at_marks and "\n" not in inside
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[END] = i
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].replace(MARK, " ").encode() for i in range(self.size)]
        self._pairs: dict[int, bool] = {}
        self._edges: tuple[dict[int, tuple | None], dict[int, tuple | None]] = {}, {}
        self._shared = {s for s, n in Counter(self.scores.values()).items() if n > 1}
        self._units: dict[str, bytes] = {}
        self._arrays: tuple[Suffixes, Borders] | None = None

    def merged(self, text: str, made: list | None = None) -> list[str]:
        """Pieces of a short text by merges of the highest score, leftmost first. made: takes the merges in order."""
        part: list[str | None] = list(text)
        n = len(part)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (s := self.scores.get(both := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if part[i] is None or (j := right[i]) < 0 or part[i] + part[j] != both:
                continue
            part[i], part[j], right[i] = both, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
            if made is not None:
                made.append((i, both))
        return [x for x in part if x is not None]

    def edge(self, i: int, last: bool) -> tuple | None:
        """What stands at the last (or first) place of piece i while it is merged, from the character to the piece, each with the
        score of the merge that takes it in. None where merges do not make the piece, or some merge scores above one before it or like another piece's."""
        found = self._edges[last]
        if i not in found:
            found[i] = None
            made: list[tuple[int, str]] = []
            piece = self.pieces[i]
            whole = self.merged(piece, made) == [piece]
            scores = [self.scores[both] for _, both in made]
            if whole and scores == sorted(scores, reverse=True) and self._shared.isdisjoint(scores):
                now, out = piece[-1] if last else piece[0], []
                for (at, both), s in zip(made, scores, strict=True):
                    if at + len(both) == len(piece) if last else at == 0:
                        out += [now, s]
                        now = self.pieces[self.ids[both]]
                found[i] = (*out, now, -math.inf)
        return found[i]

    def follows(self, a: int, b: int) -> bool:
        """Whether merges leave piece b after piece a; always so where one of them is outside the vocabulary."""
        key = a * self.size + b
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self.stays(a, b)
        return found

    def stays(self, a: int, b: int) -> bool:
        """Each side's merges go by falling scores, so both together do: no merge over the border may come before those that take in its parts."""
        x, y = self.edge(a, True), self.edge(b, False)
        if x is None or y is None:
            return self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        i, j, scores = 0, 0, self.scores
        while True:
            s, p, q = scores.get(x[i] + y[j]), x[i + 1], y[j + 1]
            if s is not None and s > p and s >= q:  # of equal scores the left one goes first
                return False
            if i + 2 == len(x) and j + 2 == len(y):
                return True
            if p >= q:
                i += 2
            else:
                j += 2

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode()) if self.bytes else (self.unknown,)

    def walk(self, units: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(unit, ids as 32-bit integers) of sorted distinct units, with the states of shared prefixes reused.

        The state of a prefix is its best score, the last piece of its best path with that piece's first place, and the
        pieces begun that may go on (places in the vocabulary's own trie, the longest first).
        """
        before = ""
        score, last, begins, active = [0.0], [NONE], [0], [()]
        root, merges, pairs, size = self.trie, self.merges, self._pairs, self.size
        scores = [self.scores.get(p, 0.0) for p in self.pieces]
        for unit in units:
            at, most = 0, min(len(before), len(unit))
            while at < most and before[at] == unit[at]:
                at += 1
            del score[at + 1 :], last[at + 1 :], begins[at + 1 :], active[at + 1 :]
            for end in range(at + 1, len(unit) + 1):
                c = unit[end - 1]
                going, best, piece, begin = [], None, NONE, end - 1
                for start, node in (*active[end - 1], (end - 1, root)):
                    node = node.get(c)
                    if node is None:
                        continue
                    going.append((start, node))
                    i = node.get(END)
                    if i is None:
                        continue
                    if merges:
                        if best is None:
                            a = last[start]
                            ok = a < 0 or pairs.get(a * size + i)
                            if ok is None:
                                ok = self.follows(a, i)
                            if ok:
                                best, piece, begin = 0.0, i, start
                    elif best is None or score[start] + scores[i] > best:
                        best, piece, begin = score[start] + scores[i], i, start
                score.append(score[end - 1] - 1e4 if best is None else best)
                last.append(piece)
                begins.append(begin)
                active.append(tuple(going))
            out: list[int] = []
            end = len(unit)
            while end:
                if last[end] >= 0:
                    out.append(last[end])
                else:
                    out.extend(reversed(self.fallback(unit[end - 1])))
                end = begins[end]
            out.reverse()
            yield unit, array("i", out).tobytes()
            before = unit

    def walk_all(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """walk(), some characters at a time, by levels as far as at least WIDE units are so long; longer units go one by one."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // WALKED)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(units)], strict=True):
            some = units[lo:hi]
            longest = int(np.sort(sizes[lo:hi])[-WIDE]) if self.merges and len(some) >= WIDE else 0
            short = [u for u in some if len(u) <= longest]
            if short:
                yield from zip(short, self.walk_levels(short), strict=True)
            yield from self.walk(u for u in some if len(u) > longest)

    def walk_levels(self, units: list[str]) -> list[bytes]:
        """The ids that walk() gives with a merge vocabulary, a level of the trie at a time: the states of all prefixes of so
        many characters.

        States lie at one place for each unit and length from 0. A prefix is worked out at the first unit that has it; the
        units after it take its state.
        """
        if self._arrays is None:
            self._arrays = Suffixes(self.ids), Borders(self)
        ends, borders = self._arrays
        codes = np.frombuffer("\0".join(["", *units]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        at0 = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        last, begins = np.full(len(codes), NONE, np.int32), np.zeros(len(codes), np.int32)
        rows, state, shared = np.arange(len(units)), np.zeros(len(units), np.int32), np.arange(len(units)) > 0
        for end in range(1, int(sizes.max()) + 1):
            rows = rows[sizes[rows] >= end]
            at, above = at0[rows] + end, np.maximum(rows - 1, 0)
            c = codes[at]
            shared[rows] = same = shared[rows] & (sizes[above] >= end) & (codes[at0[above] + end] == c)
            first = np.flatnonzero(~same)
            where = at0[rows[first]]
            now = ends.step(state[rows[first]], ends.kind[c[first]])
            piece, begin = np.full(len(first), NONE, np.int32), np.full(len(first), end - 1, np.int32)
            tried = ends.longest[now]
            open = np.flatnonzero(tried)
            while open.size:
                i, start = ends.piece[tried[open]], end - ends.length[tried[open]]
                a = last[where[open] + start]
                ok = a < 0
                ok[~ok] = borders.follow(a[~ok], i[~ok])
                piece[open[ok]], begin[open[ok]] = i[ok], start[ok]
                open = open[~ok]
                tried[open] = ends.shorter[tried[open]]
                open = open[tried[open] > 0]
            of = np.cumsum(~same) - 1
            last[at], begins[at], state[rows] = piece[of], begin[of], now[of]
        path = np.zeros(len(codes), bool)
        rows, to = np.arange(len(units)), sizes
        while rows.size:
            at = at0[rows] + to
            path[at] = True
            to = begins[at]
            rows, to = rows[to > 0], to[to > 0]
        at = np.flatnonzero(path)
        made = last[at]
        bounds = (4 * np.searchsorted(at, np.append(at0, len(codes)))).tolist()
        ids = made.tobytes()
        out = [ids[lo:hi] for lo, hi in zip(bounds, bounds[1:], strict=False)]
        for k in np.unique(np.searchsorted(at0, at[made < 0], "right") - 1).tolist():
            here = slice(bounds[k] // 4, bounds[k + 1] // 4)
            chars = (at[here] - at0[k] - 1).tolist()
            spelt = [(i,) if i >= 0 else self.fallback(units[k][p]) for i, p in zip(made[here].tolist(), chars, strict=True)]
            out[k] = array("i", [i for s in spelt for i in s]).tobytes()
        return out

    def parts(self, text: str) -> list[str]:
        """A text's units, in order. A plain text is split at single spaces and before line ends; others go through the pattern."""
        if not text:
            return []
        if self.plain and not (text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or MARK in text):
            marked = text.replace(" ", f" {MARK}").replace("\n", " \n")
            return (MARK + marked).split(" ")
        return self.unit.findall(MARK + text.replace(" ", MARK))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers."""
        of = [self.parts(t) for t in texts]
        known = self._units
        every = set().union(*of)
        known.update(self.walk_all(sorted(every.difference(known))))
        out = [b"".join(map(known.__getitem__, units)) for units in of]
        if len(known) > CACHED_UNITS:
            known = self._units = {u: known[u] for u in every} if len(every) <= CACHED_UNITS else {}
        for u in [u for u in every if len(u) > LONG_UNIT]:
            known.pop(u, None)
        return out

    def decode(self, ids: bytes | list[int]) -> str:
        """The text; byte pieces are joined before they are decoded."""
        raw = self.raw
        text = b"".join([raw[i] for i in (memoryview(ids).cast("i") if isinstance(ids, bytes) else ids)]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def model_type(model: bytes) -> int:
    """trainer_spec.model_type of a serialised model: 1 unigram (the default), 2 BPE."""

    def varint(buf: bytes, k: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (buf[k] & 0x7F) << shift
            k, shift = k + 1, shift + 7
            if buf[k - 1] < 0x80:
                return value, k

    def fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
        k = 0
        while k < len(buf):
            tag, k = varint(buf, k)
            kind = tag & 7
            if kind == 0:
                value, k = varint(buf, k)
            else:
                size, k = (8, k) if kind == 1 else (4, k) if kind == 5 else varint(buf, k)
                value, k = buf[k : k + size], k + size
            yield tag >> 3, value

    spec = next((v for n, v in fields(model) if n == 2), b"")
    return next((v for n, v in fields(spec) if n == 3), 1)


_loaded: dict[bytes, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """Built once in each worker process, with its caches."""
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Vocabulary(model)
    return _loaded[model]


def encode_documents(docs: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, ids, n_tokens and round_trip (whether decoding gives the text back) of every row."""

    def run(batches):
        v = vocabulary(model)
        for b in slices(batches, ROWS):
            texts = [x.as_py() or "" for x in b.column("text")]
            ids = v.encode_batch(texts)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat = np.frombuffer(b"".join(ids), np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            same = pa.array([v.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists, pa.array(sizes), same], [*keep, "ids", "n_tokens", "round_trip"])

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>", "n_tokens bigint", "round_trip boolean"]))


def decode_documents(encoded: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and text of every row of ids."""

    def run(batches):
        v = vocabulary(model)
        for b in slices(batches, ROWS):
            out = pa.array([v.decode(x.as_py() or []) for x in b.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), out], [*keep, "text"])

    kinds = dict(encoded.dtypes)
    return encoded.select(*keep, "ids").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"]))


def read_model(path: str = TOKENIZER) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), read_model())
