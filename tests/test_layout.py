"""Neighbour graph and embedding against dense numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import layout as LO
from peakloom.params import Params
from peakloom.functions import peaks as P

from conftest import make_spectra

COSINE = Params(distance_method="cosine")


def two_families(spark, n=24, copies=3):
    rng = np.random.default_rng(5)
    base = np.zeros((2, 12))
    base[0, :6] = base[1, 6:] = 1.0
    rows = []
    for i in range(n):
        v = base[i % 2] + rng.uniform(0.1, 0.5, 12)
        rows.append((f"s{i}", [(100.0 + 10 * j, float(x)) for j, x in enumerate(v)]))
    rows += [(f"c{i}", rows[0][1]) for i in range(copies)]
    x = make_spectra(spark, rows)
    return x.withColumn("frag", P.prep_peaks(F.col("peaks"), COSINE)).drop("peaks")


def dense(spectra):
    rows = sorted(spectra.select("pos", "frag").collect(), key=lambda r: r["pos"])
    v = np.array([[p["intensity"] for p in r["frag"]] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return np.round(1 - v @ v.T, 10)


def scale_of(gap, target):
    lo, hi = -20.0, 20.0
    for _ in range(48):
        mid = (lo + hi) / 2
        if sum(np.exp(-g / 2.0 ** mid) for g in gap) > target:
            hi = mid
        else:
            lo = mid
    return 2.0 ** ((lo + hi) / 2)


@pytest.mark.parametrize("k", [2, 6])
def test_graph_matches_brute_force(spark, k):
    x = two_families(spark)
    d, w = dense(x), {}
    for i in range(len(d)):
        order = sorted((j for j in range(len(d)) if j != i), key=lambda j: (max(d[i, j], 0), j))[:k - 1]
        near = np.maximum(d[i, order], 0)
        rho = min(near[near > 0], default=0.0)
        gap = np.maximum(near - rho, 0)
        scale = max(scale_of(gap, np.log2(k)), 1e-3 * near.mean())
        w.update({(i, j): np.exp(-g / scale) for j, g in zip(order, gap)})
    want = {}
    for (i, j), u in w.items():
        v = w.get((j, i), 0.0)
        want[i, j] = want[j, i] = u + v - u * v
    got = {(r["a"], r["b"]): r["weight"] for r in LO.neighbour_graph(x, COSINE, k, fragment_only=True).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[e] - want[e]) < 1e-6 for e in want)


def test_sizes_are_checked(spark):
    x = two_families(spark, 2, 0)
    with pytest.raises(ValueError, match="at least 3"):
        LO.neighbour_graph(x, COSINE, fragment_only=True)
    y = two_families(spark, 3, 0)
    for bad in (1, 3, 2.5):
        with pytest.raises(ValueError, match="between 2"):
            LO.neighbour_graph(y, COSINE, bad, fragment_only=True)


def test_curve_is_the_published_one():
    assert np.allclose(LO.curve_parameters(0.05), (1.7502, 0.8421), atol=2e-3)


def test_pushes_match_loops():
    y = np.random.default_rng(1).normal(size=(7, 2))
    y[3] = y[2]
    a, b = 1.75, 0.84
    want = np.zeros_like(y)
    for i in range(7):
        for j in range(7):
            g = y[i] - y[j]
            want[i] += np.clip(2 * b / ((0.001 + g @ g) * (1 + a * (g @ g) ** b)) * g, -4, 4) / 6
    assert np.allclose(LO.pushes(y, a, b), want)


def test_start_is_the_leading_direction(spark):
    """Against the eigenvectors of the dense matrix; hubs dealt over several keys change nothing."""
    n = 20
    edges = [(i, j, 1.0) for i in range(n) for j in range(n) if i != j and i // 10 == j // 10] + [(9, 10, 0.5), (10, 9, 0.5)]
    e = spark.createDataFrame(edges, "a long, b long, weight double")
    nodes = spark.range(n + 1).select(F.col("id").alias("node"))  # the last has no edge
    few, LO.FEW_EDGES = LO.FEW_EDGES, 4
    try:
        graph = LO.Graph(e, nodes)
        assert graph.nodes.agg(F.max("shares")).first()[0] > 1
        assert graph.edges.count() == len(edges)
        got = {r["node"]: r["V1"] for r in LO.spectral_start(graph, 2, steps=15).collect()}
    finally:
        LO.FEW_EDGES = few
    m = np.zeros((n, n))
    for i, j, w in edges:
        m[i, j] = w
    s = 1 / np.sqrt(m.sum(1))
    val, vec = np.linalg.eigh(s[:, None] * m * s[None, :])
    want, have = vec[:, -2], np.array([got[i] for i in range(n)])
    assert abs(want @ have) / np.linalg.norm(have) > 0.999
    assert np.isfinite(got[n])


def test_families_part(spark):
    x = two_families(spark)
    rows = LO.embed(x, COSINE, fragment_only=True, epochs=4).collect()
    assert len(rows) == 27 and {r["id"] for r in rows} >= {"s0", "c0"}
    y = {r["pos"]: np.array([r["V1"], r["V2"]]) for r in rows}
    family = {k: (0 if k >= 24 else k % 2) for k in y}
    close = sum(family[min((j for j in y if j != i), key=lambda j: ((y[i] - y[j]) ** 2).sum())] == family[i] for i in y)
    assert close >= 25
