"""Metrics over all pairs without a row per pair: equal to those of the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import benchmark as B
from peakloom.operators import metrics as M
from peakloom.operators import pair_order as PO
from peakloom.operators import search as S
from peakloom.operators import stats as ST
from peakloom.operators.blocks import in_order
from peakloom.params import Params
from tests.conftest import make_spectra


def spectra(spark, n=48, grid=True, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.gamma(0.6, size=12) * (rng.random(12) < 0.8) + 0.01
        if i % 8 == 1:
            v = last
        last = v
        mz = [50 + 5.0 * g if grid else 50 + 5.0 * g + rng.normal(0, 3e-4) for g in range(12)]
        key = None if i % 11 == 3 else f"COMPOUND-{i % 4:05d}-{i % 3}"
        rows.append((str(i), list(zip(mz, v)), key, float(600 + 37 * i % 300)))
    return make_spectra(spark, rows, ["inchikey string", "ri double"]).withColumn("frag", F.col("peaks")).drop("peaks").persist()


def one(df):
    return [pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for v in df.first()]


@pytest.mark.parametrize("method,grid", [("composite", True), ("cosine", False)])
def test_retrieval_and_auc(spark, method, grid):
    s, p = spectra(spark, grid=grid), Params(distance_method=method)
    keys = B.labels_of(s, "inchikey")
    lazy = M.attach_keys(S.AllPairs(s, p, fragment_only=True), keys)
    # equal distances as equal numbers in the table too
    table = M.attach_keys(S.distance_table(s, p, fragment_only=True).withColumn("distance", F.round("distance", 13)), keys)
    assert list(M.precision_at_k(lazy).first()) == one(M.precision_at_k(table))
    assert list(M.ordered_discrimination(lazy).first()) == one(M.ordered_discrimination(table))
    assert list(M.auc_of_spectra(s, p, fragment_only=True).first()) == one(M.auc_roc(M.scored_pairs(s, p, fragment_only=True)))
    got = {r["transform"]: r for r in M.similarity_summary(lazy).collect()}
    for r in M.similarity_summary(table).collect():
        assert [got[r["transform"]][c] for c in ("mean", "low", "high")] == [pytest.approx(r[c], abs=1e-9) for c in ("mean", "low", "high")]


def test_library_retrieval(spark):
    s, p = spectra(spark), Params(distance_method="cosine")
    q, lib = s.filter("pos % 2 = 0"), s.filter("pos % 2 = 1")
    for window in (None, 60.0):
        lazy = B.library_pairs(q, lib, p, window, True)
        args = B.labels_of(q, "inchikey"), B.labels_of(lib, "inchikey")
        assert list(M.library_retrieval(lazy, *args).first()) == one(M.library_retrieval(lazy.rows(), *args))


def test_agreement_counts_inversions(spark):
    s = spectra(spark)
    a, b = (S.AllPairs(s, Params(distance_method=m), fragment_only=True) for m in ("cosine", "hellinger"))
    got = ST.backend_agreement(a, b).first()
    assert list(got) == one(ST.backend_agreement(*(x.rows().filter("q_pos <> l_pos") for x in (a, b))))
    assert got["rank_inversions"] > 0


def test_pairs_are_ordered_in_passes(spark, monkeypatch):
    s, p = spectra(spark), Params(distance_method="cosine")
    want = M.auc_of_spectra(s, p, fragment_only=True).first()
    seen, whole = [], PO._bin_wins
    monkeypatch.setattr(PO, "PASS_VALUES", 1)
    monkeypatch.setattr(PO, "LEAST_VALUES", 40)
    monkeypatch.setattr(PO, "GROUP_VALUES", 2)
    monkeypatch.setattr(PO, "_bin_wins", lambda *x: seen.append(len(x[-1])) or whole(*x))
    assert M.auc_of_spectra(s, p, fragment_only=True).first() == want
    assert len(seen) > 1


def test_equal_distances_go_by_position():
    d = np.array([[0.5, 0.2, 0.5, np.nan, 0.2, 0.9]])
    rel = np.array([[True, False, False, True, True, False]])
    use = np.array([[True, True, True, True, True, False]])
    row, rank, n = in_order(d, rel, use)
    assert rank.tolist() == [1, 2, 4] and n.tolist() == [5]
    wide = np.tile(d + 5, (1, 1))  # beyond what one integer holds
    assert in_order(wide, rel, use)[1].tolist() == [1, 2, 4]


def test_ablation_in_one_pass_equals_setting_by_setting(spark):
    s = spectra(spark, 40)
    for c in ("loss", "loss_anchor", "loss_pair"):
        s = s.withColumn(c, F.reverse(F.transform("frag", lambda x: F.struct((700 - x["mz"]).alias("mz"), x["intensity"].alias("intensity")))))
    p = Params(distance_method="cosine")
    settings = [p.with_(use_split_loss=split, w_frag=wf, w_loss=wl, loss_anchor_weight=0.5 if a is None else a) for _, split, wf, wl, a in B.ABLATION[:5:2]]
    got = {(r["no"], r["q_pos"]): r["best_rank"] for r in M.replicate_ranks_of(s, settings).collect()}
    want = {(i, r["q_pos"]): r["best_rank"] for i, x in enumerate(settings) for r in M.replicate_ranks(s, x).collect()}
    assert got == want and len(got) > 60
