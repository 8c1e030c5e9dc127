"""Batch distance kernels: many spectrum pairs per call, values in [0, 1].

Two forms exist per method.  ``pair_distances`` scores an explicit list of pairs
with ppm alignment.  ``matrix_distances`` scores all pairs of two blocks: when the
blocks share a true m/z grid it works on dense matrices, otherwise it scores only
pairs that can have a common peak (all others are exactly 1).
"""

from __future__ import annotations

import numpy as np

from ..constants import DISTANCE_METHODS, NEAR_ZERO
from . import transport
from .ragged import Batch, align, common_grid, seg_sum, sharing_pairs, spans

CHUNK = 4096


def check_method(method: str) -> str:
    if method not in DISTANCE_METHODS:
        raise ValueError(f"distance method must be one of: {', '.join(DISTANCE_METHODS)}")
    return method


def is_symmetric(method: str, ot_method: str = "exact") -> bool:
    """Composite and the finite-iteration transport methods depend on direction."""
    return not (method == "composite"
                or (method == "ppm_wasserstein" and ot_method in ("sinkhorn", "greenkhorn")))


def needs_common_peak(method: str) -> bool:
    """True when spectra without a common peak are exactly at distance 1."""
    return method != "wasserstein"


def _clamp(x):
    return np.minimum(np.maximum(x, 0.0), 1.0)


def _cosine(pp, qq, pq):
    norm = np.sqrt(pp) * np.sqrt(qq)
    ok = (np.sqrt(pp) > NEAR_ZERO) & (np.sqrt(qq) > NEAR_ZERO)
    return np.where(ok, 1 - pq / np.where(ok, norm, 1.0), 1.0)


def _ratio_term(rp, rq):
    """min/max agreement of consecutive intensity ratios; (value, usable)."""
    ok = np.isfinite(rp) & np.isfinite(rq) & (rp > NEAR_ZERO) & (rq > NEAR_ZERO)
    lo, hi = np.minimum(rp, rq), np.maximum(rp, rq)
    return np.where(ok, lo / np.where(ok, hi, 1.0), 0.0), ok


def _composite(sw, nx, nxy, ratio_sum, n_valid):
    sr = ratio_sum / np.maximum(n_valid, 1)
    mixed = (nx * sw + nxy * sr) / np.maximum(nx + nxy, 1)
    plain = (nxy < 2) | (nx == 0) | (n_valid == 0)
    return 1 - _clamp(np.where(plain, sw, mixed))


def _xlog(x):
    return np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0)), 0.0)


def entropy_weights(b: Batch) -> Batch:
    """Normalise, and flatten low-entropy spectra: p^(0.25 + S/4) when S < 3."""
    row, n = b.row_of_peak(), len(b)
    s = seg_sum(b.it, row, n)
    p = b.it / np.where(s > 0, s, 1.0)[row]
    ent = -seg_sum(_xlog(p), row, n)
    power = np.where(ent < 3, 0.25 + 0.25 * ent, 1.0)
    p = p ** power[row]
    s = seg_sum(p, row, n)
    return Batch(b.mz, p / np.where(s > 0, s, 1.0)[row], b.off)


def unit_sum(b: Batch) -> Batch:
    row = b.row_of_peak()
    s = seg_sum(b.it, row, len(b))
    return Batch(b.mz, b.it / np.where(s > 0, s, 1.0)[row], b.off)


def _entropy_pairs(a: Batch, b: Batch, ia, ib, ppm):
    """Two-pointer one-to-one matching, advanced for all pairs in lockstep."""
    sim = np.zeros(len(ia))
    i, ie, j, je = a.off[ia].copy(), a.off[ia + 1], b.off[ib].copy(), b.off[ib + 1]
    live = np.flatnonzero((i < ie) & (j < je))
    while len(live):
        x, y = a.mz[i[live]], b.mz[j[live]]
        gap, tol = x - y, x * ppm * 1e-6
        hit = np.abs(gap) <= tol
        h = live[hit]
        p, q = a.it[i[h]], b.it[j[h]]
        sim[h] += _xlog(p + q) - _xlog(p) - _xlog(q)
        i[live[hit | (gap < -tol)]] += 1
        j[live[hit | (gap > tol)]] += 1
        live = live[(i[live] < ie[live]) & (j[live] < je[live])]
    return _clamp(1 - sim / (2 * np.log(2)))


def _wasserstein_pairs(mz_a, w_a, pair_a, mz_b, w_b, pair_b, n):
    """Area between the two cumulative curves on each pair's own [min, max] axis."""
    sa, sb = seg_sum(w_a, pair_a, n), seg_sum(w_b, pair_b, n)
    usable = (sa > 0) & (sb > 0)
    pair = np.concatenate([pair_a, pair_b])
    mz = np.concatenate([mz_a, mz_b])
    w = np.concatenate([w_a / np.where(sa > 0, sa, 1)[pair_a], -w_b / np.where(sb > 0, sb, 1)[pair_b]])
    order = np.lexsort((mz, pair))
    pair, mz, w = pair[order], mz[order], w[order]
    if not len(mz):
        return np.ones(n)
    head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    run = np.cumsum(w)
    run -= np.repeat(np.append(0.0, run[head[1:] - 1]), np.diff(np.append(head, len(mz))))
    step = np.append(mz[1:] - mz[:-1], 0.0)
    step[np.append(pair[1:] != pair[:-1], True)] = 0.0
    area = seg_sum(np.abs(run) * step, pair, n)
    lo, hi = np.full(n, np.inf), np.full(n, -np.inf)
    lo[pair[head]] = mz[head]
    hi[pair[head]] = mz[np.append(head[1:], len(mz)) - 1]
    width = hi - lo
    flat = ~(width > NEAR_ZERO)
    d = np.where(flat, 0.0, area / np.where(flat, 1.0, width))
    return np.where(usable, _clamp(d), 1.0)


def pair_distances(a: Batch, b: Batch, ia, ib, method: str, p) -> np.ndarray:
    """Distance of row ia[k] of ``a`` to row ib[k] of ``b`` for every k."""
    check_method(method)
    ia, ib = np.asarray(ia, np.int64), np.asarray(ib, np.int64)
    out = np.ones(len(ia))
    if method in ("entropy", "entropy_weighted", "entropy_unweighted"):
        prep = unit_sum if method == "entropy_unweighted" else entropy_weights
        a, b = prep(a), prep(b)
    todo = np.flatnonzero((a.sizes[ia] > 0) & (b.sizes[ib] > 0))
    for s in range(0, len(todo), CHUNK):
        k = todo[s:s + CHUNK]
        out[k] = _score(a, b, ia[k], ib[k], method, p)
    return out


def _score(a, b, ia, ib, method, p):
    n, ppm = len(ia), p.tol_ppm
    if method.startswith("entropy"):
        return _entropy_pairs(a, b, ia, ib, ppm)
    if method in ("wasserstein", "ppm_wasserstein") and p.wasserstein_align:
        pair, mz, x, y = align(a, b, ia, ib, ppm)
        sides = []
        for w in (x, y):
            keep = w > 0
            off = np.concatenate([[0], np.cumsum(np.bincount(pair[keep], minlength=n))])
            sides.append(Batch(mz[keep], w[keep], off))
        a, b = sides
        ia = ib = np.arange(n)
    if method == "wasserstein":
        na, nb = a.sizes[ia], b.sizes[ib]
        sa, sb = spans(a.off[ia], na), spans(b.off[ib], nb)
        return _wasserstein_pairs(a.mz[sa], a.it[sa], np.repeat(np.arange(n), na),
                                  b.mz[sb], b.it[sb], np.repeat(np.arange(n), nb), n)
    if method == "ppm_wasserstein":
        if (p.ot_method or "exact") in ("exact", "exact_sparse"):
            return transport.exact_distance(a, b, ia, ib, ppm * p.wasserstein_transition_mult)
        return np.array([transport.diagnosed_distance(
            a.mz[a.off[i]:a.off[i + 1]], a.it[a.off[i]:a.off[i + 1]],
            b.mz[b.off[j]:b.off[j + 1]], b.it[b.off[j]:b.off[j + 1]],
            ppm, p.wasserstein_transition_mult, p.ot_method, p.sinkhorn_epsilon,
            p.sinkhorn_niter)["distance"] for i, j in zip(ia, ib)])

    pair, mz, x, y = align(a, b, ia, ib, ppm)
    if method == "hellinger":
        return np.sqrt(seg_sum((np.sqrt(x) - np.sqrt(y)) ** 2, pair, n)) / np.sqrt(2)
    if method == "cosine":
        return _cosine(seg_sum(x * x, pair, n), seg_sum(y * y, pair, n), seg_sum(x * y, pair, n))
    m = mz ** p.mass_power
    wx, wy = m * x ** p.intensity_power, m * y ** p.intensity_power
    wx, wy = np.where(x > 0, wx, 0.0), np.where(y > 0, wy, 0.0)
    sw = 1 - _cosine(seg_sum(wx * wx, pair, n), seg_sum(wy * wy, pair, n), seg_sum(wx * wy, pair, n))
    if method == "weighted_cosine":
        return _clamp(1 - sw)
    both = np.flatnonzero((x > 0) & (y > 0))
    nx = np.bincount(pair[x > 0], minlength=n)
    nxy = np.bincount(pair[both], minlength=n)
    c, d = both[:-1], both[1:]
    same = pair[c] == pair[d]
    c, d = c[same], d[same]
    val, ok = _ratio_term(x[c] / x[d], y[c] / y[d])
    return _composite(sw, nx, nxy, seg_sum(val, pair[c], n), seg_sum(ok.astype(float), pair[c], n))


def _grid_matrix(grid, P, Q, method, p):
    """All pairs of two blocks on a shared grid; one pass over grid columns."""
    n, m = len(P), len(Q)
    if method == "cosine":
        return _cosine((P * P).sum(1)[:, None], (Q * Q).sum(1)[None, :], P @ Q.T)
    if method == "hellinger":
        A, B = np.sqrt(P), np.sqrt(Q)
        sq = np.maximum(1 - A @ B.T, 0.0)
        i, j = np.nonzero(sq < 1e-6)  # near-equal rows: the product cancels, the difference does not
        for s in range(0, len(i), CHUNK):
            r, c = i[s:s + CHUNK], j[s:s + CHUNK]
            sq[r, c] = ((A[r] - B[c]) ** 2).sum(1) / 2
        return np.sqrt(sq)
    if method in ("weighted_cosine", "composite"):
        w = grid ** p.mass_power
        A = np.where(P > 0, w * P ** p.intensity_power, 0.0)
        B = np.where(Q > 0, w * Q ** p.intensity_power, 0.0)
        cos = _cosine((A * A).sum(1)[:, None], (B * B).sum(1)[None, :], A @ B.T)
        if method == "weighted_cosine":
            return _clamp(cos)
        sum_r, n_ok, nxy = np.zeros((n, m)), np.zeros((n, m)), np.zeros((n, m))
        last_p, last_q = np.full((n, m), np.nan), np.full((n, m), np.nan)
        for g in range(len(grid)):
            r, c = np.flatnonzero(P[:, g] > 0), np.flatnonzero(Q[:, g] > 0)
            if not len(r) or not len(c):
                continue
            at = np.ix_(r, c)
            x, y = P[r, g][:, None], Q[c, g][None, :]
            val, ok = _ratio_term(last_p[at] / x, last_q[at] / y)
            sum_r[at] += val
            n_ok[at] += ok
            nxy[at] += 1
            last_p[at], last_q[at] = np.broadcast_to(x, val.shape), np.broadcast_to(y, val.shape)
        return _composite(1 - cos, (P > 0).sum(1)[:, None], nxy, sum_r, n_ok)
    if method.startswith("entropy"):
        if method != "entropy_unweighted":
            P, Q = (_entropy_rows(M) for M in (P, Q))
        sim = np.zeros((n, m))
        for g in range(len(grid)):
            r, c = np.flatnonzero(P[:, g] > 0), np.flatnonzero(Q[:, g] > 0)
            if len(r) and len(c):
                x, y = P[r, g][:, None], Q[c, g][None, :]
                sim[np.ix_(r, c)] += _xlog(x + y) - _xlog(x) - _xlog(y)
        return _clamp(1 - sim / (2 * np.log(2)))
    if method == "wasserstein":
        area = np.zeros((n, m))
        cp, cq = P.cumsum(1), Q.cumsum(1)
        for g in range(len(grid) - 1):
            area += np.abs(cp[:, g][:, None] - cq[:, g][None, :]) * (grid[g + 1] - grid[g])
        first = [grid[(M > 0).argmax(1)] for M in (P, Q)]
        last = [grid[M.shape[1] - 1 - (M > 0)[:, ::-1].argmax(1)] for M in (P, Q)]
        width = (np.maximum(last[0][:, None], last[1][None, :])
                 - np.minimum(first[0][:, None], first[1][None, :]))
        flat = width <= NEAR_ZERO
        return _clamp(np.where(flat, 0.0, area / np.where(flat, 1.0, width)))
    overlap = np.zeros((n, m))  # ppm transport on isolated m/z: only equal m/z can match
    for g in range(len(grid)):
        overlap += np.minimum(P[:, g][:, None], Q[:, g][None, :])
    return _clamp(1 - overlap)


def _entropy_rows(M):
    ent = -_xlog(M).sum(1)
    power = np.where(ent < 3, 0.25 + 0.25 * ent, 1.0)
    M = np.where(M > 0, M ** power[:, None], 0.0)
    s = M.sum(1, keepdims=True)
    return M / np.where(s > 0, s, 1.0)


def matrix_distances(a: Batch, b: Batch, method: str, p, mask=None) -> np.ndarray:
    """Distance matrix of two blocks; entries outside ``mask`` are left at 1."""
    check_method(method)
    exact_ot = method != "ppm_wasserstein" or (p.ot_method or "exact") in ("exact", "exact_sparse")
    reach = p.tol_ppm
    if method == "ppm_wasserstein":
        reach = max(reach, p.tol_ppm * p.wasserstein_transition_mult)
    empty = (a.sizes == 0)[:, None] | (b.sizes == 0)[None, :]
    if exact_ot and (mask is None or mask.mean() > 0.05):
        grid = common_grid(a, b, reach)
        if grid is not None:
            return np.where(empty, 1.0, _grid_matrix(*grid, method, p))
    want = ~empty if mask is None else mask & ~empty
    if needs_common_peak(method):
        want = want & sharing_pairs(a, b, reach)
    out = np.ones((len(a), len(b)))
    ia, ib = np.nonzero(want)
    if len(ia):
        out[ia, ib] = pair_distances(a, b, ia, ib, method, p)
    return out


# --- channel combination --------------------------------------------------

def _block_meet(u, v):
    return u[:, None] & v[None, :]


def _row_meet(u, v):
    return u & v


def _unit(c):
    return np.clip(np.where(np.isfinite(c), c, 0.0), 0, 1)


def _row_confidence(conf_a, conf_b):
    return np.sqrt(_unit(conf_a) * _unit(conf_b))


def _confidence(conf_a, conf_b):
    """sqrt(cA*cB) with both sides clamped; missing confidence counts as 0."""
    return np.sqrt(_unit(conf_a)[:, None] * _unit(conf_b)[None, :])


def combine_rows(a: dict, b: dict, method: str, p, conf=None) -> dict:
    """Combined distance of row k of ``a`` against row k of ``b``, for every k."""
    def score(x, y):
        rows = np.arange(len(x))
        return pair_distances(x, y, rows, rows, method, p)

    return combine_blocks(score, a, b, p, conf, confidence=_row_confidence, meet=_row_meet)


def combine_blocks(score, a: dict, b: dict, p, conf=None, confidence=_confidence,
                   meet=_block_meet) -> dict:
    """Fragment and derived-spectrum distance of two blocks with every component.

    ``a``/``b`` map channel names to Batches; ``score(x, y)`` gives the distances and
    ``meet(u, v)`` the logical AND of per-row flags in the same shape.
    """
    use_conf = p.use_mref_confidence and conf is not None
    conf_pair = confidence(*conf) if use_conf else None
    d_frag = score(a["frag"], b["frag"])
    out = {"d_frag": d_frag}

    def blend(raw, name, scaled):
        """Mix in the typical-loss channel where both spectra have one."""
        if not p.use_typical_loss or name not in a:
            return raw, None, np.zeros_like(raw)
        both = meet(a[name].sizes > 0, b[name].sizes > 0)
        w = np.full_like(raw, 1 - np.clip(p.loss_raw_beta, 0, 1))
        if scaled and use_conf:
            w = w * conf_pair ** p.loss_typical_conf_gamma
        w = np.where(both, np.clip(w, 0, 1), 0.0)
        typ = score(a[name], b[name])
        return np.sqrt((1 - w) * raw ** 2 + w * np.where(both, typ, 0.0) ** 2), np.where(both, typ, np.nan), w

    if not p.use_split_loss:
        raw = score(a["loss"], b["loss"]) if p.w_loss > 0 or "loss" in a else np.ones_like(d_frag)
        d_loss, typ, w = blend(raw, "loss_typ", True)
        out.update(d_loss=d_loss, d_loss_raw=raw, w_loss_typical=w, w_loss_raw=1 - w)
        if typ is not None:
            out["d_loss_typ"] = typ
    else:
        def channel(name):
            x, y = a[name], b[name]
            none = meet(x.sizes == 0, y.sizes == 0)
            return np.where(none, 0.0, score(x, y)), none

        anchor_raw, no_anchor = channel("loss_anchor")
        pair_raw, no_pair = channel("loss_pair")
        anchor, a_typ, wa_typ = blend(anchor_raw, "loss_anchor_typ", True)
        pair, p_typ, wp_typ = blend(pair_raw, "loss_pair_typ", False)
        base = np.clip(p.loss_anchor_weight, 0, 1)
        wa = np.full_like(d_frag, base)
        if use_conf:
            wa = wa * conf_pair ** p.loss_anchor_conf_gamma
        wa = np.where(no_anchor, 0.0, wa)
        wp = np.where(no_pair, 0.0, 1 - base)
        s = wa + wp
        live = s > 0
        wa, wp = np.where(live, wa / np.where(live, s, 1), 0.0), np.where(live, wp / np.where(live, s, 1), 0.0)
        d_loss = np.where(live, np.sqrt(wa * anchor ** 2 + wp * pair ** 2), 1.0)
        out.update(d_loss=d_loss, d_anchor=anchor, d_anchor_raw=anchor_raw, d_pair=pair,
                   d_pair_raw=pair_raw, w_anchor_final=wa, w_pair_final=wp,
                   w_anchor_typical=wa_typ, w_pair_typical=wp_typ)
        if a_typ is not None:
            out.update(d_anchor_typ=a_typ, d_pair_typ=p_typ)
    if use_conf:
        out["conf_pair"] = conf_pair
    out["distance"] = np.sqrt(p.w_frag * d_frag ** 2 + p.w_loss * out["d_loss"] ** 2)
    return out


def contributions(c: dict, p) -> dict:
    """Squared shares of each component; 0 where the denominator is not positive."""
    def share(num, den):
        return np.where(den > 0, num / np.where(den > 0, den, 1.0), 0.0)

    total = c["distance"] ** 2
    out = {"c_frag_total": share(p.w_frag * c["d_frag"] ** 2, total),
           "c_loss_total": share(p.w_loss * c["d_loss"] ** 2, total)}
    if "d_anchor" in c:
        den = c["d_loss"] ** 2
        out["c_anchor_in_loss"] = share(c["w_anchor_final"] * c["d_anchor"] ** 2, den)
        out["c_pair_in_loss"] = share(c["w_pair_final"] * c["d_pair"] ** 2, den)
        for ch in ("anchor", "pair"):
            if f"d_{ch}_typ" in c:
                typ = np.nan_to_num(c[f"d_{ch}_typ"])
                out[f"c_{ch}_typ_in_{ch}"] = share(c[f"w_{ch}_typical"] * typ ** 2, c[f"d_{ch}"] ** 2)
    elif "d_loss_typ" in c:
        typ = np.nan_to_num(c["d_loss_typ"])
        out["c_loss_typ_in_loss"] = share(c["w_loss_typical"] * typ ** 2, c["d_loss"] ** 2)
    return out
