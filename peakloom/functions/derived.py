"""Mass-difference spectra for a whole Arrow batch of fragment spectra."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .ragged import Batch, spans


def to_arrow(b: Batch):
    mz, it = pa.array(b.mz), pa.array(b.it)
    peaks = pa.StructArray.from_arrays([mz, it], names=["mz", "intensity"])
    return pa.ListArray.from_arrays(pa.array(b.off.astype(np.int32)), peaks)


def strongest(b: Batch, k: int) -> np.ndarray:
    """Positions of the k most intense peaks per row, strongest first, ties in order."""
    row = b.row_of_peak()
    order = np.lexsort((np.arange(len(row)), -b.it, row))
    rank = np.arange(len(row)) - b.off[row[order]]
    return order[rank < k]


def summarize(row, mz, it, n, max_peaks) -> Batch:
    """Sum per (row, m/z at 3 decimals), keep the strongest bins, normalise."""
    mz = np.rint(mz * 1000) / 1000
    order = np.lexsort((mz, row))
    row, mz, it = row[order], mz[order], it[order]
    if len(row):
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (mz[1:] != mz[:-1])))
        row, mz, it = row[first], mz[first], np.add.reduceat(it, first)
    off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    out = Batch(mz, it, off)
    if len(row) and (out.sizes > max_peaks).any():
        keep = np.sort(strongest(out, max_peaks))
        row, mz, it = row[keep], mz[keep], it[keep]
    s = np.bincount(row, it, n)
    ok = s[row] > 0
    row, mz, it = row[ok], mz[ok], it[ok]
    return Batch(mz, it / s[row], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]))


def difference_channels(frag: Batch, mref, confidence, masses_of_row, p):
    """(pooled, anchored, pairwise) spectra.

    ``masses_of_row`` maps a row-index array to a list of (mass, row mask) that are
    down-weighted before binning.
    """
    n, row = len(frag), frag.row_of_peak()
    a_mz, a_it, a_row = mref[row] - frag.mz, frag.it, row
    if p.use_mref_confidence:
        a_it = a_it * (confidence ** p.mref_conf_power)[row]

    top = strongest(frag, p.loss_top_peaks)
    t_row = row[top]
    t_n = np.bincount(t_row, minlength=n)
    t_off = np.concatenate([[0], np.cumsum(t_n)])
    at = np.arange(len(top))
    size = t_off[t_row + 1] - at - 1
    i, j = np.repeat(at, size), spans(at + 1, size)
    b_mz = np.abs(frag.mz[top[i]] - frag.mz[top[j]])
    b_it = np.minimum(frag.it[top[i]], frag.it[top[j]])
    b_row = t_row[i]

    sides = []
    for mz, it, rw in ((a_mz, a_it, a_row), (b_mz, b_it, b_row)):
        ok = np.isfinite(mz) & (mz >= p.loss_min) & (mz <= p.loss_max)
        mz, it, rw = mz[ok], it[ok].copy(), rw[ok]
        for mass, rows in masses_of_row:
            hit = (np.abs(mz - mass) <= mass * p.tol_ppm * 1e-6) & rows[rw]
            it[hit] *= p.derivatization_raw_loss_weight
        sides.append((rw, mz, it))
    pooled = [np.concatenate(c) for c in zip(*sides)]
    return tuple(summarize(*c, n, p.loss_max_peaks) for c in (pooled, *sides))
