"""Cheap lower bounds of distances on a shared m/z grid, and exact values of chosen pairs.

When all m/z of a cell are further apart than the tolerance, alignment is the identity and
spectra are rows of dense matrices (``Plane``).  ``lower`` bounds every pair of two planes
from below in single precision: products for the cosine family, a fitted cosine series of the
additive kernel for entropy, rounded-up integers for the overlap, sums over neighbouring
columns for Wasserstein.  What a bound can't rule out is scored by ``exact_rows``, each pair by
itself, so that a pair's value doesn't depend on the tile it stands in.
"""

from __future__ import annotations

import numpy as np

from ..constants import NEAR_ZERO
from .distances import CHUNK, _clamp, _composite, _cosine, _entropy_rows, _grid_matrix, _ratio_term, _xlog

#: Wider grids are left to the tile by tile kernels.
MOST_COLUMNS = 256
#: More than single precision can be off in a bound.
MARGIN = np.float32(2e-5)
#: Terms of the cosine series, and how far it may be off before more are taken.
MOST_TERMS, OFF = 8, 2e-3
#: Groups of neighbouring columns of the Wasserstein bound.
GROUPS = 16
#: Rows of a strip that stays in the cache while columns are added up.
STRIP = 64
UNITS = 60_000


class Plane:
    """Spectra of one channel as rows on the grid of their cell, scaled to unit sum."""

    def __init__(self, values, sizes):
        self.values, self.sizes, self.kept = values, sizes, {}

    def __len__(self):
        return len(self.values)

    def keep(self, name, make):
        if name not in self.kept:
            self.kept[name] = make(self.values)
        return self.kept[name]


class Rows:
    """Chosen rows of a plane, gathered as they are asked for."""

    def __init__(self, plane, rows):
        self.plane, self.rows = plane, rows
        self.sizes = plane.sizes[rows]

    def take(self, name, make):
        return self.plane.keep(name, make)[self.rows]


def shared_planes(batches: list, reach: float):
    """(grid, a plane per batch), or None where alignment may not be the identity or a row isn't a plain spectrum."""
    grid = np.unique(np.concatenate([np.unique(b.mz) for b in batches])) if batches else np.zeros(0)
    if len(grid) > MOST_COLUMNS or not np.isfinite(grid).all():
        return None
    if len(grid) > 1 and (np.diff(grid) <= grid[1:] * reach * 1.001e-6).any():
        return None
    if not len(grid):
        grid = np.ones(1)  # no peak at all: every spectrum is empty
    out = []
    for b in batches:
        m = np.zeros((len(b), len(grid)))
        np.add.at(m, (b.row_of_peak(), np.searchsorted(grid, b.mz)), b.it)
        s = m.sum(1, keepdims=True)
        if not (np.isfinite(b.it).all() and (b.it >= 0).all() and (s[b.sizes > 0] > NEAR_ZERO).all()):
            return None
        s[s <= 0] = 1.0
        out.append(Plane(m / s, b.sizes))
    return grid, out


def _unit_rows(m):
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.where(n > NEAR_ZERO, m / np.where(n > NEAR_ZERO, n, 1.0), 0.0)


def _js_kernel(w):
    """Entropy similarity of x and y over sqrt(x y), by w = log(x / y)."""
    return (2 * np.cosh(w / 2) * np.log(2 * np.cosh(w / 2)) - w * np.sinh(w / 2)) / (2 * np.log(2))


def cosine_series(span: float):
    """(frequencies, weights, how far off): a cosine series of the entropy kernel for log ratios up to ``span``.

    The kernel is at most 1, so one term of weight 1 is an upper bound where no series is close.
    """
    span = max(span, 1e-3) * 1.001
    w = np.linspace(0, span, 4001)
    for terms in range(3, MOST_TERMS + 1):
        freq = np.arange(terms) * np.pi / (span * 1.25)
        basis = np.cos(w[:, None] * freq)
        weight = np.linalg.lstsq(basis, _js_kernel(w), rcond=1e-9)[0]
        # between two points neither side bends by more than this
        bend = (w[1] - w[0]) ** 2 / 8 * ((np.abs(weight) * freq ** 2).sum() + 1)
        off = np.abs(_js_kernel(w) - basis @ weight).max() + bend
        if off <= OFF:
            break
    return (freq, weight, off) if off <= 0.05 else (np.zeros(1), np.ones(1), 0.0)


class Screen:
    """Bounds and exact values of one method over the planes of one cell and channel."""

    def __init__(self, grid, planes, method, p):
        self.grid, self.method, self.p = grid, method, p
        if method.startswith("entropy") or method == "composite":
            low, high = np.inf, 0.0
            for x in planes:
                m = x.values if method == "composite" else x.keep("e", self.entropy)
                if (m > 0).any():
                    low, high = min(low, m[m > 0].min()), max(high, m.max())
            #: Ratios far from 1 may be left out of a composite distance.
            self.wide = high > 1e6 * low
        if method.startswith("entropy"):
            self.freq, self.weight, self.off = cosine_series(np.log(high / low) if high > 0 else 0.0)

    # --- what is kept of a plane ---

    def entropy(self, v):
        return v if self.method == "entropy_unweighted" else _entropy_rows(v)

    def weights(self, v):
        return np.where(v > 0, self.grid ** self.p.mass_power * v ** self.p.intensity_power, 0.0)

    def factor(self, v):
        """Rows whose products are the similarity."""
        if self.method == "hellinger":
            return np.sqrt(v)
        return _unit_rows(v if self.method == "cosine" else self.weights(v))

    def single(self, plane):
        return plane.keep("s", lambda v: plane.keep("f", self.factor).astype(np.float32))

    def waves(self, plane, scaled):
        def make(_):
            m = plane.keep("e", self.entropy)
            root, log = np.sqrt(m), np.log(np.where(m > 0, m, 1.0))
            out = []
            for f, a in zip(self.freq, self.weight if scaled else np.ones_like(self.weight)):
                out.append(a * root * np.cos(f * log))
                if f:
                    out.append(a * root * np.sin(f * log))
            return np.concatenate(out, 1).astype(np.float32)
        return plane.keep("q" if scaled else "l", make)

    # --- bounds ---

    def lower(self, x: Plane, y: Plane):
        """No pair is nearer than this, in single precision."""
        m = self.method
        if m in ("cosine", "weighted_cosine", "hellinger"):
            s = self.single(x) @ self.single(y).T
            np.subtract(1 - MARGIN, s, out=s)
            np.maximum(s, 0, out=s)
            if m == "hellinger":
                np.sqrt(s, out=s)
                s -= MARGIN
        elif m.startswith("entropy"):
            s = self.waves(x, True) @ self.waves(y, False).T
            np.subtract(np.float32(1 - self.off) - MARGIN, s, out=s)
            np.maximum(s, 0, out=s)
        elif m == "ppm_wasserstein":
            s = self._overlap(x, y)
        elif m == "wasserstein":
            s = self._coarse_area(x, y)
        else:
            s = self._composite_bound(x, y)
        empty = x.sizes == 0, y.sizes == 0
        if empty[0].any():
            s[empty[0]] = 1 - MARGIN
        if empty[1].any():
            s[:, empty[1]] = 1 - MARGIN
        return s

    def _overlap(self, x, y):
        a, b = (np.ascontiguousarray(t.keep("u", lambda v: np.ceil(v * UNITS).astype(np.uint16).T)) for t in (x, y))
        # a row adds up to UNITS + columns at most: no sum overflows
        total = np.empty((a.shape[1], b.shape[1]), np.uint16)
        _add_columns(total, a, b)
        return np.float32(1) - MARGIN - total.astype(np.float32) / np.float32(UNITS)

    def _ends(self, v):
        on = v > 0
        return self.grid[on.argmax(1)], self.grid[v.shape[1] - 1 - on[:, ::-1].argmax(1)]

    def _width(self, x, y):
        (a, b), (c, d) = (t.keep("ends", self._ends) for t in (x, y))
        return np.maximum(b[:, None], d[None, :]) - np.minimum(a[:, None], c[None, :])

    def _coarse_area(self, x, y):
        """Columns of a group add up with their signs, which is never more than the area between the curves."""
        def make(v):
            step = np.diff(self.grid) / max(self.grid[-1] - self.grid[0], NEAR_ZERO)
            area = v.cumsum(1)[:, :-1] * step
            cuts = np.unique(np.linspace(0, area.shape[1], GROUPS + 1).astype(int)[:-1])
            return np.add.reduceat(area, cuts, 1).astype(np.float32).T.copy() if area.shape[1] else np.zeros((1, len(v)), np.float32)

        a, b = (t.keep("w", make) for t in (x, y))
        both = np.zeros((a.shape[1], b.shape[1]), np.float32)
        _add_columns(both, a, b)
        both *= -2  # |u - v| = u + v - 2 min(u, v)
        both += a.sum(0)[:, None]
        both += b.sum(0)[None, :]
        both -= MARGIN
        span = self.grid[-1] - self.grid[0]
        if all((s == self.grid[e]).all() for t in (x, y) for e, s in zip((0, -1), t.keep("ends", self._ends))):
            return both  # all on the whole axis
        width = self._width(x, y)
        return np.where(width > NEAR_ZERO, np.maximum(both, 0) * np.float32(span) / np.maximum(width, NEAR_ZERO).astype(np.float32) - MARGIN,
                        0).astype(np.float32)

    def _composite_bound(self, x, y):
        """Ratios over neighbouring columns; a ratio over a gap counts as full agreement."""
        def ratios(v):
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                r = np.where((v[:, :-1] > 0) & (v[:, 1:] > 0), v[:, :-1] / v[:, 1:], 0.0)
                return r.astype(np.float32).T.copy(), np.where(r > 0, 1 / r, 0.0).astype(np.float32).T.copy()

        def flags(v):
            on = v > 0
            return on.astype(np.float32), (on[:, :-1] & on[:, 1:]).astype(np.float32)

        cos = self.single(x) @ self.single(y).T
        cos += MARGIN
        (u, iu), (v, iv) = (t.keep("r", ratios) for t in (x, y))
        (on_x, next_x), (on_y, next_y) = (t.keep("on", flags) for t in (x, y))
        total = np.zeros_like(cos)
        buf, other = np.empty((STRIP, cos.shape[1]), np.float32), np.empty((STRIP, cos.shape[1]), np.float32)
        for s in range(0, len(total), STRIP):
            part = total[s:s + STRIP]
            b, o = buf[:len(part)], other[:len(part)]
            for g in range(len(u)):
                np.multiply(u[g, s:s + STRIP, None], iv[g][None, :], out=b)
                np.multiply(iu[g, s:s + STRIP, None], v[g][None, :], out=o)
                np.minimum(b, o, out=b)
                part += b
        common = on_x @ on_y.T
        valid = np.maximum(common - 1, 0)
        if next_x.shape[1]:
            total += valid - next_x @ next_y.T
        ratio = np.minimum(total / np.maximum(valid, 1) + MARGIN, 1)
        if self.wide:
            ratio[:] = 1
        n = on_x.sum(1)[:, None]
        mixed = (n * cos + common * ratio) / np.maximum(n + common, 1)
        plain = (common < 2) | self.wide
        mixed[plain] = np.maximum(mixed, cos)[plain]
        return 1 - MARGIN - np.minimum(mixed, 1)

    def _composite_dense(self, x, y):
        """Ratios over neighbouring columns as products, those over a gap pair by pair."""
        def ratios(v):
            r = np.where((v[:, :-1] > 0) & (v[:, 1:] > 0), v[:, :-1] / np.where(v[:, 1:] > 0, v[:, 1:], 1.0), 0.0)
            return r.T.copy(), np.where(r > 0, 1 / np.where(r > 0, r, 1.0), 0.0).T.copy()

        P, Q = x.values, y.values
        (u, iu), (v, iv) = (t.keep("r64", ratios) for t in (x, y))
        total = np.zeros((len(P), len(Q)))
        buf, other = np.empty((STRIP, len(Q))), np.empty((STRIP, len(Q)))
        for s in range(0, len(P), STRIP):
            part = total[s:s + STRIP]
            b, o = buf[:len(part)], other[:len(part)]
            for g in range(len(u)):
                np.multiply(u[g, s:s + STRIP, None], iv[g][None, :], out=b)
                np.multiply(iu[g, s:s + STRIP, None], v[g][None, :], out=o)
                np.minimum(b, o, out=b)
                part += b
        on_p, on_q = P > 0, Q > 0
        flat, m = total.ravel(), len(Q)
        for g in range(2, P.shape[1]):
            a, b = np.flatnonzero(on_p[:, g]), np.flatnonzero(on_q[:, g])
            near = on_p[a, g - 1], on_q[b, g - 1]
            some, lone = (a[~near[0]], b), (a[near[0]], b[~near[1]])
            i = np.concatenate([np.repeat(s[0], len(s[1])) for s in (some, lone)])
            j = np.concatenate([np.tile(s[1], len(s[0])) for s in (some, lone)])
            for c in range(g - 2, -1, -1):  # the last common column before
                if not len(i):
                    break
                met = on_p[i, c] & on_q[j, c]
                at, to = i[met], j[met]
                flat[at * m + to] += _ratio_term(P[at, c] / P[at, g], Q[to, c] / Q[to, g])[0]
                i, j = i[~met], j[~met]
        A, B = (t.keep("m", self.weights) for t in (x, y))
        cos = _cosine((A * A).sum(1)[:, None], (B * B).sum(1)[None, :], A @ B.T)
        common = on_p.astype(float) @ on_q.T.astype(float)
        return _composite(1 - cos, on_p.sum(1)[:, None], common, total, np.maximum(common - 1, 0))

    # --- exact values ---

    def exact_rows(self, x: Rows, y: Rows):
        out = np.empty(len(x.rows))
        for s in range(0, len(out), CHUNK):
            part = slice(s, s + CHUNK)
            out[part] = self._rows(Rows(x.plane, x.rows[part]), Rows(y.plane, y.rows[part]))
        return np.where((x.sizes == 0) | (y.sizes == 0), 1.0, out)

    def _rows(self, x, y):
        m, plain = self.method, lambda v: v
        if m == "cosine":
            P, Q = x.take("", plain), y.take("", plain)
            return _cosine((P * P).sum(1), (Q * Q).sum(1), (P * Q).sum(1))
        if m == "hellinger":
            A, B = x.take("f", self.factor), y.take("f", self.factor)
            sq = np.maximum(1 - (A * B).sum(1), 0.0)
            near = np.flatnonzero(sq < 1e-6)
            sq[near] = ((A[near] - B[near]) ** 2).sum(1) / 2
            return np.sqrt(sq)
        if m.startswith("entropy"):
            P, Q = x.take("e", self.entropy), y.take("e", self.entropy)
            row, g = np.nonzero((P > 0) & (Q > 0))
            a, b = P[row, g], Q[row, g]
            return _clamp(1 - np.bincount(row, _xlog(a + b) - _xlog(a) - _xlog(b), len(P)) / (2 * np.log(2)))
        P, Q = x.take("", plain), y.take("", plain)
        if m == "ppm_wasserstein":
            return _clamp(1 - np.minimum(P, Q).sum(1))
        if m == "wasserstein":
            area = (np.abs(P.cumsum(1) - Q.cumsum(1))[:, :-1] * np.diff(self.grid)).sum(1)
            (a, b), (c, d) = self._ends(P), self._ends(Q)
            width = np.maximum(b, d) - np.minimum(a, c)
            flat = width <= NEAR_ZERO
            return _clamp(np.where(flat, 0.0, area / np.where(flat, 1.0, width)))
        A, B = x.take("m", self.weights), y.take("m", self.weights)
        cos = _cosine((A * A).sum(1), (B * B).sum(1), (A * B).sum(1))
        if m == "weighted_cosine":
            return _clamp(cos)
        row, g = np.nonzero((P > 0) & (Q > 0))
        a, b = P[row, g], Q[row, g]
        c = np.flatnonzero(row[:-1] == row[1:])
        val, ok = _ratio_term(a[c] / a[c + 1], b[c] / b[c + 1])
        n = len(P)
        return _composite(1 - cos, (P > 0).sum(1), np.bincount(row, minlength=n),
                          np.bincount(row[c], val, n), np.bincount(row[c], ok, n))

    def dense(self, x: Plane, y: Plane):
        """All pairs of two planes."""
        if self.method in ("cosine", "weighted_cosine"):
            d = x.keep("f", self.factor) @ y.keep("f", self.factor).T
            np.subtract(1.0, d, out=d)
            if self.method == "weighted_cosine":
                np.clip(d, 0.0, 1.0, out=d)
        elif self.method == "ppm_wasserstein":
            a, b = (t.keep("t", lambda v: np.ascontiguousarray(v.T)) for t in (x, y))
            d = np.empty((len(x), len(y)))
            _add_columns(d, a, b)
            np.clip(np.subtract(1.0, d, out=d), 0.0, 1.0, out=d)
        elif self.method == "composite" and not self.wide:
            d = self._composite_dense(x, y)
        else:
            d = _grid_matrix(self.grid, x.values, y.values, self.method, self.p)
        for at, t in ((np.s_[t_empty, :] if i == 0 else np.s_[:, t_empty], t_empty)
                      for i, t_empty in enumerate((x.sizes == 0, y.sizes == 0))):
            if t.any():
                d[at] = 1.0
        return d


def _add_columns(total, a, b):
    """total += min(a, b) summed over the columns, a strip of rows at a time."""
    total[:] = 0
    buf = np.empty((STRIP, total.shape[1]), total.dtype)
    for s in range(0, len(total), STRIP):
        part = total[s:s + STRIP]
        x = buf[:len(part)]
        for g in range(len(a)):
            np.minimum(a[g, s:s + STRIP, None], b[g][None, :], out=x)
            part += x
