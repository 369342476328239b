"""Clustering and whitening against plain numpy, on rows that are as odd as they may be."""

import hashlib
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmine.llm import centroids, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, cluster int, component int, distance long, white string, n long"


def odd_rows(dims=64, n=300):
    rng = np.random.default_rng(4)
    near = rng.normal(size=(12, dims))
    rows = [(i, [float(c) for c in np.float32(near[i % 12] + rng.normal(size=dims) * 0.4)]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)]  # one vector many times
    rows += [rows[3], rows[3], (None, rows[5][1]), (2000, [0.0] * dims), (2001, [-0.0] * dims), (2002, [-0.001] * dims)]
    rows += [(3000, None), (3001, [None] + [0.1] * (dims - 1)), (3002, [float("nan")] * dims), (3003, [float("inf")] + [0.0] * (dims - 1)), (3004, [-math.inf] * dims)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", 2, 3, 4, "w", 5) for i, e in rows], SCHEMA).repartition(3)


def finite(e):
    return e is not None and all(c is not None and math.isfinite(c) for c in e)


def brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in e]) for i, e in rows if finite(e) and len(e) == 64]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centres = [x for _, x in sorted(kept, key=key)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        centres = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else centres[j] for j in range(len(centres))]
    found = [(i, *near(x)) for i, x in kept]
    own = {j: sum(d for _, d, c in found if c == j) for j in range(k)}
    name = lambda j: hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()
    return [(i, j, d, own[j], sum(own.values()), name(j)) for i, d, j in found]


def test_clusters(spark):
    rows = [*odd_rows(), (4000, [1.0] * 63), (4001, []), (4002, [1.0] * 65)]
    got = centroids.centroid_clusters(table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    rows = odd_rows()[:n] * 2
    assert sorted(map(tuple, centroids.centroid_clusters(table(spark, rows)).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_ties_and_pruning():
    """On a small lattice many vectors are as near to several centroids; bounds of any round must leave the brute force's choice."""
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (4000, 3))
    old = rng.integers(-3, 4, (9, 3))
    cluster, upper, lower = np.zeros(4000, np.int32), np.full(4000, np.inf), np.zeros((4000, 9))
    total = 0
    for step in range(6):
        d = ((x[:, None] - old[None]) ** 2).sum(axis=2)
        own, calculated = centroids.assigned(x, old, cluster, upper, lower, step == 5)
        assert (cluster == d.argmin(axis=1)).all()  # argmin takes the first of equals
        assert ((own == -1) | (own == d.min(axis=1))).all()
        assert (upper >= np.sqrt(d.min(axis=1))).all() and (lower <= np.sqrt(d)).all()
        total += calculated.sum()
        new = old + (rng.random((9, 3)) < 0.2) * rng.integers(-1, 2, (9, 3))
        moved = np.sqrt(((new - old) ** 2).sum(axis=1)) * (1 + centroids.SLACK)
        upper[:], lower[:], old = (upper + moved[cluster]) * (1 + centroids.SLACK), np.maximum((lower - moved) * (1 - centroids.SLACK), 0), new
    assert (own >= 0).all()
    assert total < 0.8 * 6 * 9 * 4000


def test_bounds_save_distances(spark):
    vectors = centroids.integer_vectors(table(spark, odd_rows()), 64, 64)
    state, centres = centroids.elkan(vectors, centroids.first_centroids(vectors, 16, 1), 3)
    assert state.agg(F.avg("calculated")).first()[0] < 0.7 * 4 * len(centres)
    assert state.where("distance < 0").count() == 0


def test_components_too_large(spark):
    with pytest.raises(Exception, match="squared distances would not fit"):
        centroids.centroid_clusters(table(spark, [(1, [1e30] * 64)])).collect()


def test_clustering_sql(spark, tmp_path):
    rows = odd_rows()
    e = pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([e for _, e in rows], pa.list_(pa.float32()))})
    con = duckdb.connect()
    con.register("embeddings", e)
    want = con.execute(centroids.oracle())
    names = [d[0] for d in want.description]
    got = centroids.centroid_clusters(table(spark, rows)).select(*names)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def plain_whitening(rows, dims=64):
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in e)) for i, e in rows if finite(e)]
    fit = np.array(sorted({x for _, x in kept}), dtype=np.float64)
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return kept, fit, values[::-1], vectors.T[::-1]


def test_whitening(spark):
    rows = odd_rows()
    kept, fit, values, vectors = plain_whitening(rows)
    got = whitening.whitened(table(spark, rows)).collect()
    assert len(got) == 4 * len(kept) and {r["component"] for r in got} == {1, 2, 3, 4}
    sums, n = fit.sum(axis=0).astype(int), len(fit)
    deviation, white = {}, {}
    for i, x in kept:
        deviation.setdefault(i, set()).add(sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True)))
        for k in range(4):
            white.setdefault((i, k + 1), []).append((np.array(x) - fit.mean(axis=0)) @ vectors[k] / math.sqrt(values[k]))
    for r in got:
        assert r["n"] == n and {r["deviation"]} == deviation[r["vec_id"]] and 0 <= r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        assert min(abs(abs(r["whitened"]) - abs(w)) for w in white[r["vec_id"], r["component"]]) < 1e-8
    # One sign for all rows.
    for k in range(1, 5):
        signs = {round(r["whitened"] / white[r["vec_id"], k][0]) for r in got if r["component"] == k and abs(white[r["vec_id"], k][0]) > 1e-3}
        assert signs in ({1}, {-1})


def test_whitening_of_little(spark):
    none = [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 3]
    for rows in none:
        assert whitening.whitened(table(spark, rows)).collect() == []
    got = whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])])).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)
    ragged = whitening.whitened(table(spark, [(1, [1.0]), (2, [1.0, 3.0]), (None, [])])).collect()
    assert {r["component"] for r in ragged} == {1, 2} and len(ragged) == 6
    huge = whitening.whitened(table(spark, [(1, [1e8, 1.0]), (2, [-1e8, 1.0]), (3, [0.0, 2.0])])).collect()
    assert {r["vec_id"]: r["deviation"] for r in huge}[3] is not None and {r["vec_id"]: r["deviation"] for r in huge}[1] is None


def test_moments_are_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 3000, (500, 5))
    x[1] = x[0]
    found = whitening.moments(spark.createDataFrame([([int(c) for c in r],) for r in x], "x array<bigint>"))
    want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) * 500 - int(x[:, i].sum()) * int(x[:, j].sum()) for j in range(5)] for i in range(5)]
    assert found.sums == x.sum(axis=0).tolist() and (found.covariance == np.array([[w / 250000 for w in r] for r in want])).all()
