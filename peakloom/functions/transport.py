"""Optimal transport with a ppm cost that saturates at 1."""

from __future__ import annotations

import numpy as np

from ..constants import OT_MARGINAL_TOLERANCE
from .ragged import Batch, spans


def ground_cost(x, y, width):
    x, y = np.asarray(x, float), np.asarray(y, float)
    return np.minimum(np.abs(x - y) / ((x + y) / 2) * 1e6 / width, 1.0)


def check_plan(src, dst, mass, cost, a, b, tol=OT_MARGINAL_TOLERANCE):
    """Validate a transport plan; returns dict(accepted, error, total, residual)."""
    bad = dict(accepted=False, total=np.nan, residual=np.nan)
    try:
        src, dst, mass = np.asarray(src), np.asarray(dst), np.asarray(mass, float)
        if not (src.shape == dst.shape == mass.shape) or src.ndim != 1 or not len(src):
            return {**bad, "error": "invalid_plan_structure"}
        if not (np.isfinite(src.astype(float)).all() and np.isfinite(dst.astype(float)).all()
                and (src == np.floor(src)).all() and (dst == np.floor(dst)).all()):
            return {**bad, "error": "invalid_plan_index"}
    except (TypeError, ValueError):
        return {**bad, "error": "invalid_plan_structure"}
    src, dst = src.astype(int), dst.astype(int)
    if src.min() < 0 or src.max() >= len(a) or dst.min() < 0 or dst.max() >= len(b):
        return {**bad, "error": "invalid_plan_index"}
    if not np.isfinite(mass).all():
        return {**bad, "error": "nonfinite_plan_mass"}
    if mass.min() < -tol:
        return {**bad, "error": "negative_plan_mass"}
    total = float((mass * cost[src, dst]).sum())
    if not np.isfinite(total):
        return {**bad, "error": "nonfinite_total_cost"}
    residual = max(np.abs(np.bincount(src, mass, len(a)) - a).max(),
                   np.abs(np.bincount(dst, mass, len(b)) - b).max())
    if residual > tol:
        return {**bad, "residual": float(residual), "error": "marginal_residual_exceeds_tolerance"}
    return dict(accepted=True, error=None, total=total, residual=float(residual))


def best_saving(a, b, i, j, gain):
    """Largest sum(flow * gain) with row sums <= a and column sums <= b.

    Augments along the best alternating path until no path gains anything.
    """
    na, nb = len(a), len(b)
    g = np.full((na, nb), -np.inf)
    g[i, j] = gain
    flow = np.zeros((na, nb))
    left, right = np.array(a, float), np.array(b, float)
    eps, value = 1e-15, 0.0
    while True:
        # best[r]: best gain of an alternating path from a free row to row r
        best_r = np.where(left > eps, 0.0, -np.inf)
        from_c = np.full(na, -1)
        from_r = np.full(nb, -1)
        best_c = np.full(nb, -np.inf)
        for _ in range(na + nb + 1):
            reach = best_r[:, None] + g
            r = reach.argmax(0)
            val = reach[r, np.arange(nb)]
            up = val > best_c + 1e-13
            best_c[up], from_r[up] = val[up], r[up]
            back = np.where(flow > eps, best_c[None, :] - np.where(flow > eps, g, 0.0), -np.inf)
            c = back.argmax(1)
            val = back[np.arange(na), c]
            grew = val > best_r + 1e-13
            best_r[grew], from_c[grew] = val[grew], c[grew]
            if not grew.any():
                break
        ends = np.where(right > eps, best_c, -np.inf)
        end = int(ends.argmax())
        if not ends[end] > 1e-13:
            return value
        path, c, amount = [], end, right[end]
        while True:
            r = from_r[c]
            path.append((r, c, 1))
            if from_c[r] < 0:
                amount = min(amount, left[r])
                break
            path.append((r, from_c[r], -1))
            amount = min(amount, flow[r, from_c[r]])
            c = from_c[r]
            if len(path) > 4 * (na + nb):
                raise ArithmeticError("transport path did not terminate")
        for r, c, sign in path:
            flow[r, c] = max(0.0, flow[r, c] + sign * amount)
            value += sign * amount * g[r, c]
        left[path[-1][0]] -= amount
        right[end] -= amount


def component_saving(wa, wb, i, j, cost):
    """Saving of one connected component (local indices)."""
    if len(wa) == 1 or len(wb) == 1:
        order = np.argsort(cost, kind="stable")
        cap = wa[0] if len(wa) == 1 else wb[0]
        w = (wb[j] if len(wa) == 1 else wa[i])[order]
        before = np.concatenate([[0.0], np.cumsum(w)[:-1]])
        return float((np.minimum(w, np.maximum(0.0, cap - before)) * (1 - cost[order])).sum())
    return best_saving(wa, wb, i, j, 1 - cost)


def labels_of(n, i, j):
    """Connected-component label per node for a small edge list."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def band_edges(a: Batch, b: Batch, ia, ib, width):
    """All peak pairs of each spectrum pair whose cost is below 1."""
    h = width * 1e-6 / 2
    na = a.sizes[ia]
    pa_ = spans(a.off[ia], na)
    pair = np.repeat(np.arange(len(ia)), na)
    x = a.mz[pa_]
    start, stop = b.off[ib][pair], b.off[ib + 1][pair]

    def bound(target):
        lo, hi = start.copy(), stop.copy()
        while (lo < hi).any():
            mid = (lo + hi) // 2
            act = lo < hi
            less = act & (b.mz[np.minimum(mid, len(b.mz) - 1)] < target)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(act & ~less, mid, hi)
        return lo

    if not len(x) or not len(b.mz):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0)
    ratio = (1 + h) / (1 - h) if h < 1 else np.inf
    lo = bound(x / ratio * (1 - 1e-12))
    hi = bound(x * ratio * (1 + 1e-12))
    size = np.maximum(hi - lo, 0)
    i, j, pr = np.repeat(pa_, size), spans(lo, size), np.repeat(pair, size)
    cost = np.abs(a.mz[i] - b.mz[j]) / ((a.mz[i] + b.mz[j]) / 2) * 1e6 / width
    ok = cost < 1
    return pr[ok], i[ok], j[ok], cost[ok]


def exact_distance(a: Batch, b: Batch, ia, ib, width):
    """Exact capped-cost transport for many pairs; empty side = 1.

    Total = 1 - saving, and savings add up over connected components of the
    peak graph, so isolated matches are handled for all pairs in one step.
    """
    n = len(ia)
    ta = np.array([a.it[a.off[r]:a.off[r + 1]].sum() for r in range(len(a))])
    tb = np.array([b.it[b.off[r]:b.off[r + 1]].sum() for r in range(len(b))])
    usable = (ta[ia] > 0) & (tb[ib] > 0)
    saving = np.zeros(n)
    pr, i, j, cost = band_edges(a, b, ia, ib, width)
    if len(pr):
        wa = a.it[i] / ta[ia[pr]]
        wb = b.it[j] / tb[ib[pr]]
        keep = (wa > 0) & (wb > 0)
        pr, i, j, cost, wa, wb = pr[keep], i[keep], j[keep], cost[keep], wa[keep], wb[keep]
    if len(pr):
        # node keys are unique per (pair, peak)
        ki = np.unique(pr * (len(a.mz) + 1) + i, return_inverse=True)[1]
        kj = np.unique(pr * (len(b.mz) + 1) + j, return_inverse=True)[1]
        alone = (np.bincount(ki)[ki] == 1) & (np.bincount(kj)[kj] == 1)
        saving += np.bincount(pr[alone], np.minimum(wa, wb)[alone] * (1 - cost[alone]), n)
        rest = np.flatnonzero(~alone)
        if len(rest):
            ni = ki.max() + 1
            lab = labels_of(ni + kj.max() + 1, ki[rest], kj[rest] + ni)[ki[rest]]
            order = np.argsort(lab, kind="stable")
            rest, lab = rest[order], lab[order]
            for grp in np.split(rest, np.flatnonzero(np.diff(lab)) + 1):
                ui, li = np.unique(i[grp], return_inverse=True)
                uj, lj = np.unique(j[grp], return_inverse=True)
                va, vb = np.zeros(len(ui)), np.zeros(len(uj))
                va[li], vb[lj] = wa[grp], wb[grp]
                saving[pr[grp[0]]] += component_saving(va, vb, li, lj, cost[grp])
    return np.where(usable, np.clip(1 - saving, 0, 1), 1.0)


def round_plan(plan, a, b):
    """Project a positive matrix onto the transport polytope."""
    rows = plan.sum(1)
    plan = plan * np.minimum(1.0, a / np.where(rows > 0, rows, 1))[:, None]
    cols = plan.sum(0)
    plan = plan * np.minimum(1.0, b / np.where(cols > 0, cols, 1))[None, :]
    da, db = a - plan.sum(1), b - plan.sum(0)
    return plan + (np.outer(da, db) / da.sum() if da.sum() > 0 else 0.0)


def sinkhorn_plan(a, b, cost, epsilon, niter):
    k = np.exp(-cost / epsilon)
    u, v = np.ones(len(a)), np.ones(len(b))
    for _ in range(int(niter)):
        u = a / np.maximum(k @ v, 1e-300)
        v = b / np.maximum(k.T @ u, 1e-300)
    return round_plan(u[:, None] * k * v[None, :], a, b)


def greenkhorn_plan(a, b, cost, epsilon, niter):
    plan = np.exp(-cost / epsilon)
    plan /= plan.sum()

    def gap(target, now):
        return now - target + target * np.log(np.maximum(target, 1e-300) / np.maximum(now, 1e-300))

    for _ in range(int(niter)):
        rows, cols = plan.sum(1), plan.sum(0)
        gr, gc = gap(a, rows), gap(b, cols)
        r, c = gr.argmax(), gc.argmax()
        if gr[r] >= gc[c]:
            plan[r] *= a[r] / max(rows[r], 1e-300)
        else:
            plan[:, c] *= b[c] / max(cols[c], 1e-300)
    return round_plan(plan, a, b)


def diagnosed_distance(mz_p, w_p, mz_q, w_q, ppm=15.0, mult=3.0, method="exact", epsilon=0.05,
                       niter=100, tol=OT_MARGINAL_TOLERANCE, requested_only=False,
                       approx_solver=None):
    """One pair with a record of what was tried.

    Approximate methods retry with more iterations and then fall back to the exact
    answer; exact methods never switch.  ``requested_only`` makes exactly one
    approximate call and yields NaN when its plan is unusable.
    """
    mz_p, w_p, mz_q, w_q = (np.asarray(v, float) for v in (mz_p, w_p, mz_q, w_q))
    rec = dict(requested_method=method, selected_path=None, status="ok", fallback_used=False,
               distance=1.0, residual=None, attempts=[])
    if not len(mz_p) or not len(mz_q):
        return {**rec, "selected_path": "empty_spectrum"}
    every = np.concatenate([mz_p, mz_q, w_p, w_q])
    if (not np.isfinite(every).all() or min(mz_p.min(), mz_q.min()) <= 0
            or min(w_p.min(), w_q.min()) < 0 or w_p.sum() <= 0 or w_q.sum() <= 0):
        return {**rec, "selected_path": "invalid_or_nonpositive_marginal", "status": "invalid_input",
                "distance": float("nan") if requested_only else 1.0}
    a, b = w_p / w_p.sum(), w_q / w_q.sum()
    width = ppm * mult
    one = np.zeros(1, np.int64)
    side_a, side_b = (Batch(m[o], w[o], [0, len(m)]) for m, w, o in (
        (mz_p, a, np.argsort(mz_p, kind="stable")), (mz_q, b, np.argsort(mz_q, kind="stable"))))
    if method in ("exact", "exact_sparse"):
        d = float(exact_distance(side_a, side_b, one, one, width)[0])
        return {**rec, "distance": d, "selected_path": f"{method}_primary"}
    cost = ground_cost(mz_p[:, None], mz_q[None, :], width)
    if not requested_only and (cost == cost.flat[0]).all():
        return {**rec, "distance": float(cost.flat[0]), "selected_path": "analytic_constant_cost"}
    solver = approx_solver or {"sinkhorn": sinkhorn_plan, "greenkhorn": greenkhorn_plan}[method]
    ladder = [int(niter)] if requested_only else list(dict.fromkeys(
        [int(niter), max(int(niter), 500), max(int(niter), 2000)]))
    for step, iterations in enumerate(ladder):
        name = "approx_primary" if step == 0 else f"approx_retry_{iterations}"
        try:
            plan = np.asarray(solver(a, b, cost, epsilon, iterations), float)
            r, c = np.indices(plan.shape)
            res = check_plan(r.ravel(), c.ravel(), plan.ravel(), cost, a, b, tol)
        except Exception as err:  # a failing solver is an attempt, not a crash
            res = dict(accepted=False, total=np.nan, residual=np.nan, error=f"solver_error: {err}")
        rec["attempts"].append(dict(step=name, iterations=iterations, accepted=res["accepted"],
                                    error=res["error"]))
        if res["accepted"]:
            return {**rec, "distance": float(np.clip(res["total"], 0, 1)), "selected_path": name,
                    "residual": res["residual"]}
    if requested_only:
        return {**rec, "distance": float("nan"), "selected_path": "requested_only_failed",
                "status": "unusable"}
    d = float(exact_distance(side_a, side_b, one, one, width)[0])
    return {**rec, "distance": d, "selected_path": "exact_fallback", "fallback_used": True}
