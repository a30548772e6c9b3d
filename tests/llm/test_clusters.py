import hashlib
import math
import random

import numpy as np
import pytest

from lectern.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance long, x string, id long"


def frame(spark, rows):
    """Further columns clash with names that the operator uses."""
    return spark.createDataFrame([(i, v, 7, 8, "x", -1) for i, v in rows], SCHEMA)


def plain(rows, k=16, rounds=3, scale=64, size=64):
    """All of it in Python's integers."""
    kept = [(i, [math.floor(c * scale) if abs(c) < 2.0**52 else int(c) * scale for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(col) // len(of[j]) for col in zip(*of[j], strict=True)] if j in of else c for j, c in enumerate(centroids)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = {}
    for _, d, j in last:
        total[j] = total.get(j, 0) + d
    fits = lambda n: n if n < 1 << 63 else None
    return sorted((repr(i), j, fits(d), fits(total[j]), fits(sum(total.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in last)


def found(df):
    return sorted((repr(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def vectors(r, n, spread, round_to=None):
    out = [[r.gauss(0, spread) for _ in range(64)] for _ in range(n)]
    return [[round(x * round_to) / round_to for x in v] for v in out] if round_to else out


@pytest.mark.parametrize(("spread", "round_to"), [(0.15, None), (0.02, 64), (3e5, None), (1e-9, None)])
def test_against_plain_integers(spark, spread, round_to):
    """Small components tie often, large ones make float32 products coarse."""
    r = random.Random(5)
    rows = list(enumerate(vectors(r, 120, spread, round_to)))
    rows += [(900 + i, list(rows[3][1])) for i in range(60)] + [(3, list(rows[3][1])), (None, list(rows[4][1]))]
    assert found(clusters.cluster(frame(spark, rows).repartition(3))) == plain(rows)


def test_what_is_left_out_and_what_is_few(spark):
    r = random.Random(6)
    good = list(enumerate(vectors(r, 5, 1.0)))
    bad = [(50, None), (51, []), (52, [1.0] * 63), (53, [1.0] * 65), (54, [*[1.0] * 63, None]), (55, [*[1.0] * 63, float("nan")]), (56, [*[1.0] * 63, float("inf")])]
    out = clusters.cluster(frame(spark, good + bad))
    assert found(out) == plain(good) and {r["distance"] for r in out.collect()} == {0}
    assert clusters.cluster(frame(spark, bad)).count() == 0 and clusters.cluster(frame(spark, [])).count() == 0


def test_vectors_beyond_int64(spark):
    """A few huge vectors: distances that no long holds are null, everything else stays exact."""
    r = random.Random(7)
    rows = list(enumerate(vectors(r, 40, 1.0))) + [(100, [1e300] * 64), (101, [-1e300, *[0.5] * 63]), (102, [3.0e6] * 64), (103, [1e9, *[0.0] * 63])]
    got, expected = found(clusters.cluster(frame(spark, rows))), plain(rows)
    assert got == expected and any(g[2] is None for g in plain([*rows, *[(200 + i, [float(i) * 1e200] * 64) for i in range(30)]]))


def test_intervals_hold_the_exact_distances():
    """The screen never leaves out the nearest, and recomputes only where it must."""
    r = np.random.default_rng(3)
    for scale in (3, 4000, 1 << 26):
        table = r.integers(-scale, scale + 1, (16, 64))
        table[5] = table[2]
        rows = np.concatenate([r.integers(-scale, scale + 1, (400, 64)), (table[2] + table[7]) // 2 + r.integers(-1, 2, (50, 64)), table])
        nearest = clusters.Nearest(table.tolist())
        best, distance = nearest.of(rows)
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in table] for v in rows]
        assert best.tolist() == [e.index(min(e)) for e in exact] and distance.tolist() == [min(e) for e in exact]
        assert 0 < nearest.recomputed < len(rows)  # 5 and 2 tie


def test_digits():
    for v in (0, 1, -1, (1 << 32) - 1, 1 << 32, -(1 << 32), -(1 << 32) - 1, 3**90, -(3**90)):
        assert sum(d << 32 * i for i, d in enumerate(clusters.digits(v))) == v
