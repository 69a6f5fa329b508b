"""Best-first growth of one tree on a pool of leaf histograms.

A leaf's histogram is sums by (feature, bin) of weights, labels, squared labels and rows: as many numbers as features have
bins, however many rows there are. Rows stay where they are: count() gives the histogram of the smaller child of each leaf
just split, the larger is the parent's less that, and a split frees the parent's. A pool of more than CELLS keeps the
leaves of largest gain; children of others are both counted. What a leaf gains does not depend on other splits, so leaves
searched ahead of their turn change nothing: leaves are split strictly by gain, and one never split stays a leaf.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import replace

import numpy as np

from .model import Node, Tree

#: Numbers that the pool may hold, and that one step may bring to it.
CELLS, STEP_CELLS = 1 << 26, 1 << 22
MEASURES = 4

#: (the tree as searched so far, leaves to count) -> the histogram of each, [MEASURES, cells].
Count = Callable[[Tree, list[int]], dict[int, np.ndarray]]


def best_cut(h: np.ndarray, offsets: np.ndarray) -> tuple[float, int]:
    """(gain, cell) of the best split after a cell: the largest gain, then the least feature, then the least bin."""
    first, last = offsets[:-1], offsets[1:] - 1
    feature = np.repeat(np.arange(len(first)), np.diff(offsets))
    run = np.cumsum(h[[0, 1, 3]], 1)
    before = np.where(first > 0, run[:, np.maximum(first - 1, 0)], 0.0)
    left, total = run - before[:, feature], (run[:, last] - before)[:, feature]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[1] ** 2 / left[0] + (total[1] - left[1]) ** 2 / (total[0] - left[0])) / total[0] - (total[1] / total[0]) ** 2
    gain = np.where((h[3] > 0) & (left[2] < total[2]), gain, -np.inf)
    k = int(np.argmax(gain))
    return float(gain[k]), k


def node_of(k: int, depth: int, sums: np.ndarray, lam: float) -> Node:
    a, b, c, _ = sums
    mean, n = b / a, int(round(a))
    value = mean * n / (n + lam) if n + lam > 0 else 0.0
    return Node(k, depth, n, max(0.0, c / a - mean * mean), float(value), float(value))


def grow_leaves(count: Count, offsets: np.ndarray, edges: dict[int, list[float]], config, ahead: int) -> Tree:
    """A tree of at most config.leaves leaves. A leaf is split if it has 2 * min_data rows, is above max_depth and gains more than min_gain."""
    size = int(offsets[-1])
    feature = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = count({0: Node(0, 0)}, [0]).get(0)
    if whole is None or not size:
        return {0: Node(0, 0)}
    planned = {0: node_of(0, 0, whole[:, : offsets[1]].sum(1), config.lam)}
    tree, pool, rows, cut, heap = {0: replace(planned[0])}, {0: whole}, {0: whole[3, : offsets[1]].sum()}, {}, []
    ahead = max(1, min(ahead, STEP_CELLS // (MEASURES * size)))

    def searched(k: int) -> None:
        if rows[k] >= 2 * config.min_data and not 0 <= config.max_depth <= planned[k].depth:
            gain, cell = best_cut(pool[k], offsets)
            if gain > max(0.0, config.min_gain):
                cut[k] = (gain, cell)
                return
        pool.pop(k)

    def offer(k: int) -> None:
        if k in cut:
            heapq.heappush(heap, (-cut[k][0], k))

    searched(0)
    offer(0)
    n_leaves = 1
    while heap and n_leaves < config.leaves:
        if planned[heap[0][1]].is_leaf:
            todo, small, both = [k for _, k in heapq.nsmallest(min(ahead, config.leaves - n_leaves), heap) if planned[k].is_leaf], {}, []
            for k in todo:
                gain, cell = cut[k]
                f, t, a = int(feature[cell]), planned[k], len(planned)
                t.is_leaf, t.feature, t.threshold, t.gain, t.left, t.right = False, f, edges[f][cell - int(offsets[f])], gain, a, a + 1
                planned |= {a: Node(a, t.depth + 1), a + 1: Node(a + 1, t.depth + 1)}
                if k in pool:
                    left, total = (pool[k][:, offsets[f] : z].sum(1) for z in (cell + 1, offsets[f + 1]))
                    for c, sums in ((a, left), (a + 1, total - left)):
                        planned[c], rows[c] = node_of(c, t.depth + 1, sums, config.lam), sums[3]
                    small[k] = a if rows[a] <= rows[a + 1] else a + 1
                else:
                    both += [a, a + 1]
            counted = count(planned, [*small.values(), *both])
            for k in todo:
                t, parent = planned[k], pool.pop(k, None)
                for c in (t.left, t.right):
                    if c in counted:
                        pool[c] = counted[c]
                    else:
                        pool[c] = parent - counted[small[k]]
                        pool[c][:, pool[c][3] <= 0] = 0
                    if c in both:
                        sums = pool[c][:, : offsets[1]].sum(1)
                        planned[c], rows[c] = node_of(c, t.depth + 1, sums, config.lam), sums[3]
                for c in (t.left, t.right):
                    searched(c)
            for k in sorted(pool, key=lambda k: -cut[k][0])[max(1, CELLS // (MEASURES * size)) :]:
                pool.pop(k)
        _, k = heapq.heappop(heap)
        t = tree[k] = replace(planned[k])
        for c in (t.left, t.right):
            tree[c] = replace(planned[c], is_leaf=True, feature=-1, threshold=0.0, gain=0.0, left=-1, right=-1)
            offer(c)
        n_leaves += 1
    return tree
