"""Near vectors against all pairs."""

import math

import numpy as np
import pytest

from coppice.llm import rotation_codes as rc

SCHEMA = "vec_id bigint, embedding array<double>, label string, row string, ball string"


def plain(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) by all pairs, sorted."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dim = max((len(rows[k][1]) for k in good), default=1)
    unit = rc.units(np.array([rows[k][1] + [0.0] * (dim - len(rows[k][1])) for k in good]).reshape(-1, dim)) if good else np.zeros((0, 1))
    hit = unit @ unit.T >= threshold
    links, label = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, i in enumerate(good):
        links[i] = int(hit[a].sum()) - 1
        for b in np.flatnonzero(hit[a]).tolist():
            x, y = root(i), root(good[b])
            label[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, links[k], least.get(root(k)), i is not None and least.get(root(k)) == i) for k, (i, _) in enumerate(rows)), key=str)


def answer(spark, rows):
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in rc.near_vectors(df).collect()), key=str)


def turned(r, x, cosine):
    """A vector at that cosine from x."""
    e = r.normal(size=x.shape)
    e -= (e @ x) / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + math.sqrt(max(0, 1 - cosine**2)) * e / np.linalg.norm(e)


@pytest.fixture
def mixed_vectors():
    r = np.random.default_rng(3)
    rows = [r.normal(size=64) for _ in range(300)]
    for size, low, high in ((120, 0.9995, 1), (40, 0.95, 0.99), (30, 0.85, 0.95)):
        x = r.normal(size=64)
        rows += [x * 3, *(turned(r, x, c) for c in r.uniform(low, high, size))]
    rows += [rows[0]] * 25 + [rows[1] * s for s in (0.5, 7, 1e200, 1e-200)]
    rows += [turned(r, x, c) for x in rows[2:40] for c in (0.88, 0.92)]
    ids = r.permutation(len(rows)) + 5
    return [(int(i), v.tolist()) for i, v in zip(ids, rows, strict=True)]


def test_groups_copies_and_pairs(spark, mixed_vectors):
    assert answer(spark, mixed_vectors) == plain(mixed_vectors)


def test_many_homes_tiles_and_segments(spark, mixed_vectors, monkeypatch):
    for name, value in (("BUCKET", 60), ("TILE", 16), ("SEGMENT", 100), ("BLOCK", 7)):
        monkeypatch.setattr(rc, name, value)
    assert answer(spark, mixed_vectors) == plain(mixed_vectors)


def test_unsure_balls(spark, monkeypatch):
    """Balls of tight copies around a distance at which some of their members link and others do not."""
    monkeypatch.setattr(rc, "BLOCK", 7)
    r, rows = np.random.default_rng(5), []
    for _ in range(6):
        x = r.normal(size=64)
        y = turned(r, x, 0.9)
        rows += [turned(r, z, c) for z in (x, y) for c in r.uniform(0.9997, 0.99999, 30)]
    rows = [(k, v.tolist()) for k, v in enumerate(rows)]
    wanted = plain(rows)
    assert len({n for _, n, *_ in wanted}) > 10
    assert answer(spark, rows) == wanted


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0], [2.0, 0.0], [2.0, 0.0], [0.0, -1.0, 0.0], [0.0, -3.0], [1.0, 0.1]]
    rows = [*enumerate(odd), (None, [0.0, 0.0, 5.0]), (None, [1.0]), (6, [1.0]), (None, None)]
    assert answer(spark, rows) == plain(rows)
    assert answer(spark, []) == []
    assert answer(spark, [(4, None)]) == [(4, 0, 4, True)]


def test_recall_of_the_index(spark, monkeypatch):
    """Random pairs at just the threshold: the hardest links there are."""
    monkeypatch.setattr(rc, "BUCKET", 100)
    r = np.random.default_rng(8)
    base = [r.normal(size=64) for _ in range(3000)]
    rows = [(k, v.tolist()) for k, v in enumerate([*base, *(turned(r, x, 0.9001) for x in base)])]
    got, wanted = (sum(n for _, n, *_ in x) for x in (answer(spark, rows), plain(rows)))
    assert 0.97 * wanted <= got <= wanted


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.array([turned(r, v, 0.9) for v in x])
    code, factor = rc.codes(x)
    est = np.array([rc.estimates(code[k : k + 1], factor[k : k + 1], rc.rotated(y[k : k + 1]))[0, 0] for k in range(len(x))])
    assert abs(est.mean() - 0.9) < 0.005
    lack = 0.9 - est
    bound = rc.error_bounds(factor, np.full(len(x), math.acos(0.9)), 64)
    assert (lack < bound).all() and 0.15 < (lack / bound * rc.CONFIDENCE).std() < 1.5
