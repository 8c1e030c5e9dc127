"""Distance kernels against plain per-pair oracles and analytic cases."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakloom import Params
from peakloom.constants import DISTANCE_METHODS
from peakloom.functions import transport as T
from peakloom.functions.distances import combine_blocks, is_symmetric, matrix_distances, pair_distances
from peakloom.functions.ragged import Batch, align, sharing_pairs


def spectrum(rng, n, lo=50.0, hi=52.0):
    w = rng.random(n) + 1e-3
    return np.column_stack([np.sort(rng.uniform(lo, hi, n)), w / w.sum()])


def slow_align(a, b, ppm):
    mz, centres = sorted(set(a[:, 0]) | set(b[:, 0])), []
    while mz:
        group = [m for m in mz if abs(m - mz[0]) <= mz[0] * ppm * 1e-6]
        centres.append(np.mean(group))
        mz = mz[len(group):]
    sides = []
    for s in (a, b):
        v = np.array([s[(s[:, 0] >= c - c * ppm * 1e-6) & (s[:, 0] <= c + c * ppm * 1e-6), 1].sum() for c in centres])
        sides.append(v / v.sum())
    return np.array(centres), *sides


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([20.0, 2000.0]))
def test_align_matches_slow_form(seed, ppm):
    rng = np.random.default_rng(seed)
    left, right = [[spectrum(rng, rng.integers(1, 25)) for _ in range(3)] for _ in range(2)]
    ia, ib = (x.ravel() for x in np.indices((3, 3)))
    pair, mz, p, q = align(Batch.from_lists(left), Batch.from_lists(right), ia, ib, ppm)
    for k in range(9):
        c, x, y = slow_align(left[ia[k]], right[ib[k]], ppm)
        assert np.allclose(mz[pair == k], c, atol=1e-12) and np.allclose(p[pair == k], x, atol=1e-12)
        assert np.allclose(q[pair == k], y, atol=1e-12)


@pytest.mark.parametrize("method", DISTANCE_METHODS)
def test_grid_and_pair_paths_agree(method):
    rng = np.random.default_rng(3)
    axis = np.arange(50, 120, 3.0)

    def draw():
        n = rng.integers(1, 20)
        w = rng.random(n)
        return np.column_stack([np.sort(rng.choice(axis, n, replace=False)), w / w.sum()])

    rows = [draw() for _ in range(8)] + [np.zeros((0, 2))]
    a = Batch.from_lists(rows)
    ia, ib = (x.ravel() for x in np.indices((9, 9)))
    grid = matrix_distances(a, a, method, Params())
    pairs = pair_distances(a, a, ia, ib, method, Params()).reshape(9, 9)
    assert np.abs(grid - pairs).max() < 1e-12
    assert np.all(grid[8] == 1) and np.all(grid[:, 8] == 1)
    assert np.abs(np.diag(grid)[:8]).max() < 1e-12
    if is_symmetric(method):
        assert np.abs(grid - grid.T).max() < 1e-12
    assert grid.min() > -1e-12 and grid.max() < 1 + 1e-12


def test_pairs_without_common_peak_are_one():
    rng = np.random.default_rng(5)
    a = Batch.from_lists([spectrum(rng, 12, 50, 400) for _ in range(30)])
    near = sharing_pairs(a, a, 20.0)
    i, j = np.nonzero(~near)
    for m in ("cosine", "hellinger", "composite", "entropy", "weighted_cosine"):
        assert np.allclose(pair_distances(a, a, i, j, m, Params()), 1, atol=1e-14)
        full = pair_distances(a, a, *(x.ravel() for x in np.indices((30, 30))), m, Params()).reshape(30, 30)
        assert np.allclose(matrix_distances(a, a, m, Params()), full, atol=1e-12)


def test_composite_is_directional():
    a = Batch.from_lists([[(50, .6), (75, .3), (100, .1)]])
    b = Batch.from_lists([[(50.0001, .7), (100.0001, .3)]])
    ab, ba = (pair_distances(x, y, [0], [0], "composite", Params())[0] for x, y in ((a, b), (b, a)))
    assert ab != ba and not is_symmetric("composite")


def test_unknown_method_is_refused():
    with pytest.raises(ValueError):
        pair_distances(Batch.from_lists([]), Batch.from_lists([]), [], [], "euclid", Params())


# --- transport ---------------------------------------------------------------

def ot(a, b, ppm=15.0, **kw):
    return pair_distances(Batch.from_lists([a]), Batch.from_lists([b]), [0], [0], "ppm_wasserstein", Params(tol_ppm=ppm, **kw))[0]


def test_transport_analytic_cases():
    assert ot([(100, .5), (100.01, .5)], [(100.01, .5), (100.02, .5)]) == pytest.approx(.5)
    assert ot([(100, 1)], [(300, 1)]) == 1
    b = 100 * (1 + 7.5e-6) / (1 - 7.5e-6)
    assert ot([(100, 1)], [(b, 1)]) == pytest.approx(1 / 3, abs=1e-9)


def lp_by_enumeration(wa, wb, cost):
    """Optimal cost of a tiny balanced transport by splitting mass into equal units."""
    a = [i for i, w in enumerate(wa) for _ in range(w)]
    b = [j for j, w in enumerate(wb) for _ in range(w)]
    return min(sum(cost[i][j] for i, j in zip(a, perm)) for perm in itertools.permutations(b)) / len(a)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_transport_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    na, nb, units = rng.integers(1, 4), rng.integers(1, 4), 6
    split = lambda n: np.bincount(np.concatenate([np.arange(n), rng.integers(0, n, units - n)]), minlength=n)
    wa, wb = split(na), split(nb)
    ma, mb = np.sort(rng.uniform(100, 100.012, na)), np.sort(rng.uniform(100, 100.012, nb))
    cost = T.ground_cost(ma[:, None], mb[None, :], 45.0)
    want = lp_by_enumeration(list(wa), list(wb), cost)
    assert ot(np.column_stack([ma, wa]), np.column_stack([mb, wb])) == pytest.approx(want, abs=1e-10)


def test_dense_component_terminates():
    rng = np.random.default_rng(1)
    a, b = (np.column_stack([np.sort(rng.uniform(100, 100.004, 120)), rng.random(120)]) for _ in range(2))
    assert 0 <= ot(a, b) < 1


def test_plan_validation():
    A, wa = [100, 150], [.6, .4]
    B, wb = [100.001, 140, 200], [.2, .3, .5]
    cost = T.ground_cost(np.array(A, float)[:, None], np.array(B)[None, :], 45.0)
    src, dst, mass = [0, 0, 0, 1, 1], [0, 1, 2, 1, 2], [.2, .2, .2, .1, .3]
    assert T.check_plan(src, dst, mass, cost, np.array(wa), np.array(wb))["accepted"]
    assert T.check_plan(dst, src, mass, cost, np.array(wa), np.array(wb))["error"] == "invalid_plan_index"
    assert T.check_plan(src, dst, [-.1, .5, .2, .1, .3], cost, np.array(wa), np.array(wb))["error"] == "negative_plan_mass"
    assert T.check_plan(src, dst, [.3, .2, .2, .1, .3], cost, np.array(wa), np.array(wb))["error"] == "marginal_residual_exceeds_tolerance"
    assert T.check_plan(src, dst, [math.nan, .2, .2, .1, .3], cost, np.array(wa), np.array(wb))["error"] == "nonfinite_plan_mass"


@pytest.mark.parametrize("method", ["sinkhorn", "greenkhorn"])
def test_approximate_transport_contract(method):
    rng = np.random.default_rng(2)
    a, b = spectrum(rng, 6, 100, 100.02), spectrum(rng, 5, 100, 100.02)
    r = T.diagnosed_distance(a[:, 0], a[:, 1], b[:, 0], b[:, 1], method=method)
    exact = T.diagnosed_distance(a[:, 0], a[:, 1], b[:, 0], b[:, 1], method="exact")
    assert r["selected_path"] == "approx_primary" and not r["fallback_used"]
    assert exact["distance"] - 1e-9 <= r["distance"] <= 1


def test_approximate_retries_then_falls_back():
    bad = lambda a, b, c, e, n: np.zeros((len(a), len(b)))
    args = ([100.0, 101.0], [.5, .5], [100.001, 150.0], [.5, .5])
    r = T.diagnosed_distance(*args, method="sinkhorn", approx_solver=bad)
    assert [x["step"] for x in r["attempts"]] == ["approx_primary", "approx_retry_500", "approx_retry_2000"]
    assert r["fallback_used"] and r["selected_path"] == "exact_fallback"
    once = T.diagnosed_distance(*args, method="sinkhorn", approx_solver=bad, requested_only=True)
    assert math.isnan(once["distance"]) and len(once["attempts"]) == 1


# --- combination ---------------------------------------------------------------

def channels(frag, **more):
    return {"frag": Batch.from_lists(frag), **{k: Batch.from_lists(v) for k, v in more.items()}}


def combine(a, b, p, conf=None):
    return combine_blocks(lambda x, y: matrix_distances(x, y, p.distance_method, p), a, b, p, conf)


def test_empty_derived_channels():
    p = Params(distance_method="cosine")
    f = [[(100, 1.0)]]
    pooled = combine(channels(f, loss=[[]]), channels(f, loss=[[]]), p)
    assert pooled["distance"][0, 0] == pytest.approx(math.sqrt(.3))
    ps = p.with_(use_split_loss=True)
    none = channels(f, loss_anchor=[[]], loss_pair=[[]])
    assert combine(none, none, ps)["d_loss"][0, 0] == 1
    one = channels(f, loss_anchor=[[(10, 1.0)]], loss_pair=[[]])
    out = combine(one, one, ps)
    assert out["w_anchor_final"][0, 0] == 1 and out["distance"][0, 0] == pytest.approx(0, abs=1e-9)


def test_typical_blend_and_confidence():
    p = Params(distance_method="cosine", use_typical_loss=True, use_mref_confidence=True)
    a = channels([[(100, 1)]], loss=[[(10, 1)]], loss_typ=[[(15.0235, 1)]])
    b = channels([[(100, 1)]], loss=[[(20, 1)]], loss_typ=[[(15.0235, 1)]])
    c = combine(a, b, p, (np.array([.81]), np.array([1.0])))
    assert c["conf_pair"][0, 0] == pytest.approx(.9)
    assert c["w_loss_typical"][0, 0] == pytest.approx(.18)
    assert c["d_loss"][0, 0] == pytest.approx(math.sqrt(.82))
    c = combine(a, b, p, (np.array([np.nan]), np.array([1.0])))
    assert c["conf_pair"][0, 0] == 0 and c["d_loss"][0, 0] == 1
