"""Drake's bounds against full scans with Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from streetloom.llm import clusters
from streetloom.llm.clusters import Bounds, DrakeClustering, limbs, squares

SCHEMA = "vec_id long, embedding array<double>, cluster int, v string, computed long"


def brute(rows, k=16, rounds=3, width=64, scale=64):
    whole = lambda x: math.floor(scale * x) if abs(x) < 1e300 else int(x) * scale
    v = [(i, [whole(x) for x in e]) for i, e in rows if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    c = [list(x) for i, x in sorted(v, key=lambda r: (name(r[0]) if r[0] is not None else (True, ""), r[1]))[:k]]
    far = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True))
    assign = lambda: [min((far(x, y), j) for j, y in enumerate(c)) for _, x in v]
    for _ in range(rounds):
        own = [j for _, j in assign()]
        for j in range(len(c)):
            m = [x for (_, x), o in zip(v, own, strict=True) if o == j]
            if m:
                c[j] = [sum(col) // len(m) for col in zip(*m, strict=True)]
    found = assign()
    return [(i, j, d if d < 2**63 else None) for (i, _), (d, j) in zip(v, found, strict=True)], c


def vectors(rnd, n, width, spread=0.05, groups=20):
    middles = [[rnd.uniform(-1, 1) for _ in range(width)] for _ in range(groups)]
    return [(i, [x + rnd.gauss(0, spread) for x in rnd.choice(middles)]) for i in range(n)]


def order(r):
    return tuple((x is not None, x) for x in r)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, e, 5, "x", 1) for i, e in rows], SCHEMA)
    model = DrakeClustering(**options)
    return sorted((tuple(r) for r in model.run(df.repartition(5)).collect()), key=order), model


def test_limbs():
    for v in (0, -1, 5, 2**47 - 1, 2**47, -(2**47), -(2**47) - 1, 3**200, -(3**200)):
        assert sum(part << clusters.LIMB * k for k, part in enumerate(limbs(v))) == v


@pytest.mark.parametrize("big", [False, True])
def test_bounds_hold_through_moves(big):
    """Every assignment equals a full scan's, ties to the smaller number, and every bound is one."""
    rng = np.random.default_rng(7)
    factor = 1 << 30 if big else 1
    x = rng.integers(-6, 7, (400, 3)) * factor
    x = x.astype(object) if big else x.astype(float)
    c = (rng.integers(-6, 7, (9, 3)) * factor).astype(object)
    s = Bounds.scan(squares(x, c), 3)
    for step in range(12):
        new = c + (rng.integers(-1, 2, c.shape) * factor).astype(object) * (step % 3)
        drift = np.array([math.sqrt(d) * (1 + clusters.SLACK) for d in ((new - c) ** 2).sum(1)], float)
        c = new
        if step == 6:
            s.keep(2)
        s.moved(drift)
        s.revise(x, c)
        d = squares(x, c)
        assert (s.cluster == np.array([min(range(len(c)), key=lambda j, r=r: (r[j], j)) for r in d.tolist()])).all()
        r = np.sqrt(d.astype(float))
        at = np.arange(len(x))
        assert (s.upper >= r[at, s.cluster]).all() and (s.lower <= np.take_along_axis(r, s.order, 1)).all()
        others = np.ones(r.shape, bool)
        others[at, s.cluster] = False
        np.put_along_axis(others, s.order, False, 1)
        assert (s.rest <= np.where(others, r, np.inf).min(1)).all()
        assert all(len({a, *o}) == 1 + len(o) for a, o in zip(s.cluster.tolist(), s.order.tolist(), strict=True))


def test_against_full_scans(spark):
    rnd = random.Random(1)
    rows = vectors(rnd, 300, 8)
    rows += [(i, list(e)) for i, e in rows[:40]] + [(900, [0.0] * 8), (901, [0.0] * 8), (None, rows[5][1]), (None, [0.3] * 8)]
    rows += [(902, None), (903, []), (904, [1.0] * 7), (905, [None] + [1.0] * 7), (906, [math.nan] * 8), (907, [math.inf] + [0.0] * 7)]
    want, c = brute(rows, k=9, rounds=4, width=8)
    got, model = run(spark, rows, k=9, rounds=4, width=8)
    assert got == sorted(want, key=order)
    assert model.centroids.tolist() == c
    assert model.digests()[0] == hashlib.sha256(",".join(map(str, c[0])).encode()).hexdigest()


def test_bounds_save_distances(spark):
    rows = vectors(random.Random(2), 600, 16, spread=0.01, groups=12)
    want, _ = brute(rows, k=12, rounds=5, width=16)
    got, model = run(spark, rows, k=12, rounds=5, width=16)
    assert got == sorted(want, key=order)
    assert model.computed[0] == 600 * 12 and min(model.computed[2:]) < 600 * 12 / 2


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_fewer_vectors_than_centroids(spark, n):
    rows = vectors(random.Random(n), n, 4)
    want, _ = brute(rows, k=5, width=4)
    assert run(spark, rows, k=5, width=4)[0] == sorted(want)


def test_huge_components(spark):
    rows = [(1, [1e30, -1e30]), (2, [1e30, 1.0]), (3, [3.0, 4.0]), (4, [3.5, 4.5]), (5, [1e308, 0.0]), (6, [2.0**40, -(2.0**40)]), (7, [1e16, 3.3])]
    want, c = brute(rows, k=3, width=2)
    got, model = run(spark, rows, k=3, width=2)
    assert got == sorted(want) and model.centroids.tolist() == c
