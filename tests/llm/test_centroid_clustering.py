import hashlib
import math
import random

import numpy as np

from spotrates.llm import centroid_clustering as C


def brute(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(64 * x) <= C.LARGEST for x in v)]
    name = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [q for _, q in sorted(kept, key=name)[:k]]
    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        centroids = [[sum(x) // len(m) for x in zip(*m)] if (m := [q for (_, q), n in zip(kept, of) if n == c]) else old
                     for c, old in enumerate(centroids)]
    return sorted(((i, *near(q)[::-1]) for i, q in kept), key=str), centroids


def result(df, **kw):
    rows, centroids = C.clustered(df, **kw)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in rows.collect()), key=str), centroids.tolist()


def test_equals_full_search(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(i % 5, 0.4) for _ in range(64)]) for i in range(150)]
    hot = [0.25] * 64
    rows += [(1000 + i, hot) for i in range(80)]                      # a third of all
    rows += [(7, rows[7][1]), (None, [1.0] * 64), (None, [2.0] * 64), (5000, None), (5001, []), (5002, [0.0] * 63),
             (5003, [0.0] * 63 + [None]), (5004, [0.0] * 63 + [float("nan")]), (5005, [0.0] * 63 + [float("inf")]),
             (5006, [1e30] * 64), (5007, [-2.0 ** 21] * 64), (5008, [2.0 ** 21] * 64), (5009, [-1 / 64 - 1e-9] * 64)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, q int").repartition(4)
    assert result(df) == brute(rows)


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert result(spark.createDataFrame([], schema)) == ([], [])
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert result(spark.createDataFrame(rows, schema)) == brute(rows)


def test_bound_never_exceeds_distance_and_filters(spark):
    r = np.random.default_rng(1)
    centres = r.normal(0, 30, (16, 64)) * np.linspace(3, 0.1, 64)
    q = np.floor(centres[r.integers(0, 16, 800)] + r.normal(0, 4, (800, 64))).astype(np.int64)
    c = np.floor(centres).astype(np.int64)
    df = spark.createDataFrame([(q[i].tolist(),) for i in range(len(q))], "q array<int>")
    mean, axes, spread = C.principal_axes(df, 64)
    lead = C.leading(spread, C.VARIANCE)
    assert np.allclose(mean, q.mean(0)) and np.allclose(spread, np.sort(np.linalg.eigvalsh(np.cov(q.T, bias=True)))[::-1]) and lead < 20
    (z, rest), (z_c, rest_c) = C.rotated(q, mean, axes, lead), C.rotated(c, mean, axes, lead)
    full = ((q[:, None] - c[None]) ** 2).sum(2)
    bound = ((z[:, None] - z_c[None]) ** 2).sum(2) + (rest[:, None] - rest_c[None]) ** 2
    assert (bound <= full * (1 + 1e-9) + 1e-6).all()
    cluster, distance, verified = C.nearest(q, z, rest, c, z_c, rest_c)
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all() and verified.mean() < 2
    assert C.leading(np.ones(10), 0.8) == 8 and C.leading(np.zeros(3), 0.8) == 1


def test_ties_go_to_the_smaller_number():
    q = np.array([[0, 0], [4, 0]], np.int64)
    c = np.array([[2, 0], [2, 0], [-2, 0]], np.int64)
    z, r = C.rotated(q, np.zeros(2), np.eye(2), 1)
    z_c, r_c = C.rotated(c, np.zeros(2), np.eye(2), 1)
    assert C.nearest(q, z, r, c, z_c, r_c)[0].tolist() == [0, 0]
