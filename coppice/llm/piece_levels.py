"""Arrays of a piece vocabulary: what the walk over a trie of units looks up for a whole level of prefixes at once."""

from __future__ import annotations

import numpy as np

#: Slots of the table of judged borders; a border takes the slot of the one before it.
BORDERS = 1 << 18
#: Bits of a slot are taken from the top of key * MIX (2^64 by the golden ratio).
MIX = np.uint64(0x9E3779B97F4A7C15)


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - bits)).astype(np.int64)


class Table:
    """Whole numbers by keys of 0 or more; -1 where a key is not there. Open addressing, a quarter to an eighth full."""

    def __init__(self, found: dict[int, int]):
        keys, values = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        self.bits = max(4, len(found).bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at = slots(keys, self.bits)
        while keys.size:
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = slots(keys, self.bits)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        open = np.flatnonzero((there != keys) & (there >= 0))
        at = at[open]
        while open.size:
            at = (at + 1) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == keys[open]
            out[open[hit]] = self.values[at[hit]]
            more = ~hit & (there >= 0)
            open, at = open[more], at[more]
        return out


class Suffixes:
    """The pieces that end at a place, longest first, from one state a place: the longest end of what was read that begins a
    piece (Aho and Corasick). State 0 is the empty one."""

    def __init__(self, ids: dict[str, int]):
        begun = sorted({p[:k] for p in ids for k in range(1, len(p) + 1)}, key=len)
        number = {"": 0} | {p: k for k, p in enumerate(begun, 1)}
        chars = {c: k for k, c in enumerate(sorted({c for p in ids for c in p}))}
        self.kinds = len(chars)
        self.kind = np.full(0x110000, -1, np.int32)
        self.kind[[ord(c) for c in chars]] = range(self.kinds)
        size = len(number)
        parent, last = np.zeros(size, np.int64), np.zeros(size, np.int64)
        parent[1:], last[1:] = [number[p[:-1]] for p in begun], [chars[p[-1]] for p in begun]
        self.next = Table(dict(zip((parent[1:] * self.kinds + last[1:]).tolist(), range(1, size), strict=True)))
        self.length = np.array([0, *map(len, begun)], np.int32)
        self.piece = np.array([-1, *(ids.get(p, -1) for p in begun)], np.int32)
        self.shorter, self.longest, self.back = (np.zeros(size, np.int32) for _ in range(3))
        ends = np.searchsorted(self.length, range(1, self.length[-1] + 2))
        for lo, hi in zip(ends, ends[1:], strict=False):
            if self.length[lo] > 1:
                self.back[lo:hi] = self.step(self.back[parent[lo:hi]], last[lo:hi])
            self.shorter[lo:hi] = self.longest[self.back[lo:hi]]
            self.longest[lo:hi] = np.where(self.piece[lo:hi] >= 0, np.arange(lo, hi), self.shorter[lo:hi])

    def step(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The states after a character more, given by its kind (-1: in no piece)."""
        out = np.zeros(len(state), np.int32)
        open = np.flatnonzero(kind >= 0)
        state, kind = state[open].astype(np.int64), kind[open]
        while open.size:
            got = self.next.get(state * self.kinds + kind)
            hit = got >= 0
            out[open[hit]] = got[hit]
            more = ~hit & (state > 0)
            open, kind, state = open[more], kind[more], self.back[state[more]].astype(np.int64)
        return out


class Borders:
    """Whether merges leave one piece after another, for arrays of both; the arrays' form of Vocabulary.stays."""

    def __init__(self, vocabulary):
        v = self.vocabulary = vocabulary
        names = dict(v.ids)
        for c in sorted({c for p in v.ids for c in p} - names.keys()):
            names[c] = v.size + len(names)
        self.names, self.most = names, v.size + len(names) + 1
        self.joins = Table({names[p[:k]] * self.most + names[p[k:]]: i for p, i in v.ids.items() for k in range(1, len(p)) if p[:k] in names and p[k:] in names})
        #: Scores as their ranks; -1, no piece, is the last.
        self.scores = np.unique(np.fromiter(v.scores.values(), np.float64, len(v.scores)))
        self.rank = np.full(v.size + 1, -1, np.int32)
        for p, i in v.ids.items():
            self.rank[i] = np.searchsorted(self.scores, v.scores[p])
        self.known, self.odd = np.zeros(v.size, bool), np.zeros(v.size, bool)
        #: What edge() says of each piece, for its last and its first place.
        self.part, self.until = (np.full((2, v.size, v.longest), -1, np.int32) for _ in range(2))
        self.pair, self.stay = np.full(BORDERS, -1, np.int64), np.zeros(BORDERS, bool)

    def learn(self, pieces: np.ndarray) -> None:
        """Lays out the edges of pieces that come up for the first time."""
        for i in np.unique(pieces[~self.known[pieces]]).tolist():
            for side in (0, 1):
                edge = self.vocabulary.edge(i, not side)
                if edge is None:
                    self.odd[i] = True
                else:
                    self.part[side, i, : len(edge) // 2] = [self.names[x] for x in edge[::2]]
                    self.until[side, i, : len(edge) // 2 - 1] = np.searchsorted(self.scores, edge[1:-1:2])
            self.known[i] = True

    def follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """judge(), with the borders of before remembered."""
        key = a.astype(np.int64) * len(self.known) + b
        at = slots(key, BORDERS.bit_length() - 1)
        out = self.stay[at]
        new = np.flatnonzero(self.pair[at] != key)
        if new.size:
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            new_a, new_b = a[new[first]], b[new[first]]
            out[new] = self.judge(new_a, new_b)[back]
            self.pair[at[new]] = key[new]
            mine = self.pair[at[new]] == key[new]
            self.stay[at[new[mine]]] = out[new[mine]]
        return out

    def judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        self.learn(a)
        self.learn(b)
        out = np.ones(len(a), bool)
        odd = self.odd[a] | self.odd[b]
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.vocabulary.follows(int(a[k]), int(b[k]))
        open = np.flatnonzero(~odd)
        a, b = a[open], b[open]
        i, j = np.zeros(len(open), np.int64), np.zeros(len(open), np.int64)
        while open.size:
            s = self.rank[self.joins.get(self.part[0, a, i].astype(np.int64) * self.most + self.part[1, b, j])]
            p, q = self.until[0, a, i], self.until[1, b, j]
            cut = (s > p) & (s >= q)  # of equal scores the left one goes first
            out[open[cut]] = False
            left = p >= q
            i, j = i + left, j + ~left
            more = ~cut & ((p >= 0) | (q >= 0))
            open, a, b, i, j = open[more], a[more], b[more], i[more], j[more]
        return out
