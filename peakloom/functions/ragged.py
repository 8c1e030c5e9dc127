"""Arrow-backed batches of peak lists and the segment helpers used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Batch:
    """Peak lists stored flat: row r owns positions off[r] .. off[r+1]."""

    def __init__(self, mz, it, off):
        self.mz = np.asarray(mz, dtype=np.float64)
        self.it = np.asarray(it, dtype=np.float64)
        self.off = np.asarray(off, dtype=np.int64)

    @classmethod
    def from_arrow(cls, column) -> "Batch":
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # zero or many chunks left
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        if column.null_count:
            column = pa.array([v or [] for v in column.to_pylist()], column.type)
        off = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.values
        mz = flat.field("mz").to_numpy(zero_copy_only=False)
        it = flat.field("intensity").to_numpy(zero_copy_only=False)
        lo, hi = (off[0], off[-1]) if len(off) else (0, 0)
        return cls(mz[lo:hi], it[lo:hi], off - lo if len(off) else np.zeros(1, np.int64))

    @classmethod
    def from_lists(cls, rows) -> "Batch":
        rows = [np.asarray(r, dtype=float).reshape(-1, 2) for r in rows]
        off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        flat = np.concatenate(rows) if rows else np.zeros((0, 2))
        return cls(flat[:, 0], flat[:, 1], off)

    def __len__(self):
        return len(self.off) - 1

    @property
    def sizes(self):
        return np.diff(self.off)

    def row_of_peak(self):
        return np.repeat(np.arange(len(self)), self.sizes)


def spans(start, size):
    """Concatenate ranges start[i] .. start[i]+size[i]."""
    size = np.asarray(size, dtype=np.int64)
    n = int(size.sum())
    if n == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(n) - np.repeat(ends - size, size) + np.repeat(np.asarray(start, np.int64), size)


def seg_sum(values, seg, n):
    return np.bincount(seg, weights=values, minlength=n)


def window_sums(values, lo, hi):
    """sum(values[lo:hi]) for many (possibly overlapping) windows."""
    if len(lo) == 0:
        return np.zeros(0)
    padded = np.append(values, 0.0)
    idx = np.empty(2 * len(lo), np.int64)
    idx[0::2], idx[1::2] = lo, hi
    out = np.add.reduceat(padded, idx)[0::2]
    return np.where(hi > lo, out, 0.0)


def align(a: Batch, b: Batch, ia, ib, ppm: float):
    """Align row ia[k] of ``a`` with row ib[k] of ``b`` for every pair k at once.

    Distinct m/z of both sides are grouped from the left: a group holds all m/z
    within ppm of its first one and is centred on their unweighted mean; each side
    then sums its peaks within ppm of the centre.  Returns (pair, mz, p, q) per
    group, ordered by pair and m/z, with p and q normalised per pair.
    """
    n = len(ia)
    na, nb = a.sizes[ia], b.sizes[ib]
    pa_, pb_ = spans(a.off[ia], na), spans(b.off[ib], nb)
    pair = np.concatenate([np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)])
    mz = np.concatenate([a.mz[pa_], b.mz[pb_]])
    wa = np.concatenate([a.it[pa_], np.zeros(len(pb_))])
    wb = np.concatenate([np.zeros(len(pa_)), b.it[pb_]])
    order = np.lexsort((mz, pair))
    pair, mz, wa, wb = pair[order], mz[order], wa[order], wb[order]
    m = len(mz)
    if m == 0:
        z = np.zeros(0)
        return np.zeros(0, np.int64), z, z, z

    fresh = np.ones(m, bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (mz[1:] != mz[:-1])
    first = np.flatnonzero(fresh)
    wa, wb = np.add.reduceat(wa, first), np.add.reduceat(wb, first)
    pair, mz = pair[first], mz[first]
    m = len(mz)
    head = np.ones(m, bool)
    head[1:] = pair[1:] != pair[:-1]
    seg_first = np.flatnonzero(head)
    seg_no = np.cumsum(head) - 1
    seg_last = np.append(seg_first[1:], m)
    seg_end = seg_last[seg_no]

    # nxt[i]: first position outside the group anchored at i
    tol = mz * ppm * 1e-6
    nxt = np.arange(1, m + 1)
    live = np.flatnonzero(nxt < seg_end)
    while len(live):
        live = live[np.abs(mz[nxt[live]] - mz[live]) <= tol[live]]
        nxt[live] += 1
        live = live[nxt[live] < seg_end[live]]

    if (nxt == np.arange(1, m + 1)).all():
        start = np.ones(m, bool)
    else:
        start = np.zeros(m, bool)
        cur, stop = seg_first.copy(), seg_last
        while len(cur):
            start[cur] = True
            cur = nxt[cur]
            ok = cur < stop
            cur, stop = cur[ok], stop[ok]

    g0 = np.flatnonzero(start)
    g1 = np.append(g0[1:], m)
    gpair = pair[g0]
    centre = np.add.reduceat(mz, g0) / (g1 - g0)
    lower, upper = centre - centre * ppm * 1e-6, centre + centre * ppm * 1e-6
    s0, s1 = seg_first[seg_no[g0]], seg_end[g0]
    lo, hi = g0.copy(), g1.copy()
    for move in (0, 1):  # widen, then trim, each window edge
        live = np.flatnonzero(lo > s0) if move == 0 else np.flatnonzero(lo < hi)
        while len(live):
            if move == 0:
                live = live[mz[lo[live] - 1] >= lower[live]]
                lo[live] -= 1
                live = live[lo[live] > s0[live]]
            else:
                live = live[mz[lo[live]] < lower[live]]
                lo[live] += 1
                live = live[lo[live] < hi[live]]
        live = np.flatnonzero(hi < s1) if move == 0 else np.flatnonzero(hi > lo)
        while len(live):
            if move == 0:
                live = live[mz[hi[live]] <= upper[live]]
                hi[live] += 1
                live = live[hi[live] < s1[live]]
            else:
                live = live[mz[hi[live] - 1] > upper[live]]
                hi[live] -= 1
                live = live[hi[live] > lo[live]]
    p, q = window_sums(wa, lo, hi), window_sums(wb, lo, hi)
    for v in (p, q):
        s = seg_sum(v, gpair, n)
        s[s <= 0] = 1.0
        v /= s[gpair]
    return gpair, centre, p, q


def sharing_pairs(a: Batch, b: Batch, ppm: float):
    """Boolean matrix: could rows i, j hold peaks within 2*ppm of each other?

    A superset test on log-m/z buckets; a False entry proves no common peak.
    """
    out = np.zeros((len(a), len(b)), bool)
    if not len(a.mz) or not len(b.mz):
        return out
    width = -np.log1p(-min(2.0 * ppm * 1e-6, 0.5)) * 1.0001
    ka = np.floor(np.log(a.mz) / width).astype(np.int64)
    kb = np.floor(np.log(b.mz) / width).astype(np.int64)
    order = np.argsort(kb, kind="stable")
    kb, jb = kb[order], b.row_of_peak()[order]
    lo = np.searchsorted(kb, ka - 1, "left")
    hi = np.searchsorted(kb, ka + 1, "right")
    rows, size = a.row_of_peak(), hi - lo
    step = 200_000
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(size) // step)) + 1, [len(size)]])
    for s, e in zip(cuts[:-1], cuts[1:]):
        if e > s:
            out[np.repeat(rows[s:e], size[s:e]), jb[spans(lo[s:e], size[s:e])]] = True
    return out


def common_grid(a: Batch, b: Batch, ppm: float, limit: int = 2048):
    """Matrices over the union of m/z when that union is a true shared grid.

    Returns (mz, P, Q) if all distinct m/z of the two batches are further apart
    than the tolerance, so alignment is the identity; else None.
    """
    grid = np.unique(np.concatenate([a.mz, b.mz]))
    if len(grid) == 0 or len(grid) > limit:
        return None
    if len(grid) > 1 and (np.diff(grid) <= grid[1:] * ppm * 1.001e-6).any():
        return None
    out = []
    for side in (a, b):
        m = np.zeros((len(side), len(grid)))
        np.add.at(m, (side.row_of_peak(), np.searchsorted(grid, side.mz)), side.it)
        s = m.sum(1, keepdims=True)
        s[s <= 0] = 1.0
        out.append(m / s)
    return grid, out[0], out[1]
