"""Lower bounds of the block join: never above a distance, same neighbours, few pairs scored."""

import numpy as np
import pyarrow as pa
import pytest

from peakloom.constants import NEAR_ZERO
from peakloom.operators.blocks import APART, Scorer, best_strip
from peakloom.operators.similarity import Penalised
from peakloom.params import Params

METHODS = ("cosine", "weighted_cosine", "hellinger", "composite", "entropy", "entropy_weighted", "entropy_unweighted", "wasserstein", "ppm_wasserstein")
PEAKS = pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float64())]))


def tiles(n, seed=3, channels=("frag",), columns=40, size=64):
    """Left and right tiles of the same random spectra: gaps, copies and empty ones among them."""
    rng = np.random.default_rng(seed)
    out = {"id": [str(i) for i in range(n)], "pos": np.arange(n), "ri": rng.uniform(600, 700, n)}
    for c in channels:
        v = rng.gamma(0.7, size=(n, columns)) * (rng.random((n, columns)) < rng.uniform(0.1, 1, n)[:, None])
        v[1::9] = v[0]
        v[2::31] = 0
        out[c] = pa.array([[{"mz": 50 + 5.0 * g, "intensity": x} for g, x in enumerate(r) if x > NEAR_ZERO] for r in v], PEAKS)
    out["ri"][::7] = np.nan

    def side(i, p):
        t = pa.table({i: out["id"], f"{p}_pos": out["pos"], f"{p}_ri": out["ri"], f"{p}_mref_confidence": out["ri"] / 1000,
                      **{c: out[c] for c in channels}})
        return [t.slice(s, size).combine_chunks() for s in range(0, n, size)]

    return side("query_id", "q"), side("library_id", "l")


def opened(scorer, left, right):
    session = scorer.open(left, right)
    session.number(left, right)
    return session


@pytest.mark.parametrize("method", METHODS)
def test_bounds_and_exact_values(method):
    left, right = tiles(128)
    plain, scorer = Scorer(Params(distance_method=method), fragment_only=True), Scorer(Params(distance_method=method), fragment_only=True)
    want = plain.distance(left[0], right[1])
    s = opened(scorer, left, right)
    rows, cols = np.nonzero(np.ones_like(want))
    assert (s.lower(0, 1) <= want).all()
    assert np.allclose(s.exact(0, 1, rows, cols).reshape(want.shape), want, rtol=0, atol=2e-13)
    assert np.allclose(s.dense(0, 1), want, rtol=0, atol=2e-13)


@pytest.mark.parametrize("change", [{}, {"use_split_loss": True, "use_mref_confidence": True}])
@pytest.mark.parametrize("method", ["cosine", "hellinger", "entropy"])
def test_combined_channels(method, change):
    p = Params(distance_method=method, **change)
    plain, scorer = Scorer(p), Scorer(p)
    left, right = tiles(128, channels=plain.channels())
    want = plain.distance(left[0], right[1])
    s = opened(scorer, left, right)
    rows, cols = np.nonzero(np.ones_like(want))
    assert (s.lower(0, 1) <= want).all()
    assert np.allclose(s.exact(0, 1, rows, cols).reshape(want.shape), want, rtol=0, atol=2e-13)


@pytest.mark.parametrize("mode", ["none", "soft", "hard"])
def test_penalty_keeps_the_bound(mode):
    p = Params(distance_method="cosine", ri_sigma=20.0, ri_window_hard=15.0)
    left, right = tiles(128)
    s = Penalised(opened(Scorer(p, fragment_only=True), left, right), left, right, mode, p, lambda sim: 1 - sim)
    assert (s.lower(0, 1) <= s.dense(0, 1)).all()


@pytest.mark.parametrize("method", ["cosine", "hellinger", "entropy_weighted", "composite", "wasserstein", "ppm_wasserstein"])
def test_few_pairs_are_scored_for_the_same_neighbours(method):
    k, n = 3, 1024
    left, right = tiles(n, size=256)
    scorer = Scorer(Params(distance_method=method), fragment_only=True)
    whole = np.concatenate([scorer.distance(left[1], y) for y in right], 1)
    s, scored = opened(scorer, left, right), []
    exact, dense = s.exact, s.dense
    s.exact = lambda a, b, rows, cols: scored.append(len(rows)) or exact(a, b, rows, cols)
    s.dense = lambda a, b: scored.append(256 * 256) or dense(a, b)
    got = best_strip(s, 1, left[1], list(enumerate(right)), k, APART[True])
    whole[np.arange(256), 256 + np.arange(256)] = np.inf
    order = np.lexsort((np.broadcast_to(np.arange(n), whole.shape), np.round(whole, 12)))[:, :k]
    assert method in ("wasserstein", "composite") or sum(scored) < 0.75 * whole.size
    assert np.allclose(got.column("distance").to_numpy().reshape(-1, k), np.take_along_axis(whole, order, 1), rtol=0, atol=2e-13)
    assert (got.column("q_pos").to_numpy() == np.repeat(np.arange(256, 512), k)).all()
    assert (got.column("l_pos").to_numpy().reshape(-1, k) == order).mean() > 0.99


def test_near_mz_are_left_to_the_alignment():
    left, right = tiles(64)
    moved = pa.array([[{"mz": x["mz"] * (1 + 5e-6), "intensity": x["intensity"]} for x in r] for r in right[0].column("frag").to_pylist()], PEAKS)
    right[0] = right[0].set_column(right[0].column_names.index("frag"), "frag", moved)
    assert Scorer(Params(distance_method="cosine"), fragment_only=True).open(left, right) is None


@pytest.mark.parametrize("method", ["cosine", "weighted_cosine", "hellinger"])
def test_bin_products_as_columns(method):
    from peakloom.functions.ragged import Batch
    from peakloom.operators.sparse import BinGrid, BinScorer, bin_matrix

    left, right = tiles(128)
    p = Params(distance_method=method)
    g = BinGrid.from_params(p)
    want = np.round(bin_matrix(Batch.from_arrow(left[0].column("frag")), Batch.from_arrow(right[1].column("frag")), g, method, p), 13)
    s = opened(BinScorer(["frag"], g, method, p), left, right)
    rows, cols = np.nonzero(np.ones_like(want))
    assert (s.lower(0, 1) <= want + 1e-12).all()
    atol = 2e-7 if method == "hellinger" else 2e-13  # root of a rounding error where spectra are equal
    assert np.allclose(s.exact(0, 1, rows, cols).reshape(want.shape), want, rtol=0, atol=atol)
    assert np.allclose(s.dense(0, 1), want, rtol=0, atol=atol)
    near = BinScorer(["frag"], BinGrid(35.0, 650.0, 2000.0, 40000.0), method, p)
    assert near.open(left, right) is None
