"""Search, gating, clustering and statistics against brute force and hand cases."""

import math
import warnings

import numpy as np
import pytest
from conftest import make_spectra
from pyspark.sql import functions as F

from peakloom import LCSearchPlan, Params, lc_default_params
from peakloom.functions import peaks as P
from peakloom.functions.distances import pair_distances
from peakloom.functions.ragged import Batch
from peakloom.operators import clustering as CL
from peakloom.operators import explain as X
from peakloom.operators import lc as LC
from peakloom.operators import metrics as M
from peakloom.operators import search as S
from peakloom.operators import sparse as SP
from peakloom.operators import stats as ST
from peakloom.operators.blocks import Scorer, best_k, nearest
from peakloom.operators.spectra import build_channels

COS = Params(distance_method="cosine")


def random_spectra(spark, n, seed=0, hot=0.0):
    """Spectra near a shared ladder; a share ``hot`` of them carries one common peak."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        pk = {round(float(m), 4): float(v) for m, v in zip(rng.choice(np.arange(60, 200), 6) + rng.normal(0, .002, 6), rng.random(6) + .1)}
        if rng.random() < hot:
            pk[73.0474] = 2.0
        rows.append((f"s{i:03d}", sorted(pk.items()), float(600 + rng.integers(0, 300)), float(300 + rng.random() * .05)))
    return make_spectra(spark, rows, ["ri double", "precursor_mz double"]).withColumn("frag", P.tic_normalize(F.col("peaks")))


def dense(df, method, p):
    rows = df.orderBy("pos").collect()
    b = Batch.from_lists([[(x["mz"], x["intensity"]) for x in r["frag"]] for r in rows])
    ia, ib = (x.ravel() for x in np.indices((len(rows), len(rows))))
    return np.round(pair_distances(b, b, ia, ib, method, p).reshape(len(rows), -1), 13), rows


def brute_top(d, keep, k):
    out = {}
    for i in range(len(d)):
        order = sorted((d[i, j], j) for j in range(d.shape[1]) if keep[i, j] and np.isfinite(d[i, j]))
        out[i] = [j for _, j in order[:k]]
    return out


@pytest.mark.parametrize("method", ["cosine", "ppm_wasserstein", "wasserstein"])
def test_nearest_equals_brute_force(spark, method):
    df = random_spectra(spark, 70, hot=.4)
    p = Params(distance_method=method)
    d, _ = dense(df, method, p)
    want = brute_top(d, ~np.eye(70, dtype=bool), 6)
    for cell in (16, 512):
        got = {}
        for r in nearest(df, df, Scorer(p, fragment_only=True), 6, True, cell=cell).orderBy("q_pos", "rank").collect():
            got.setdefault(r["q_pos"], []).append(r["l_pos"])
        assert got == want


def test_ri_window_equals_brute_force(spark):
    df = random_spectra(spark, 60, seed=2)
    d, rows = dense(df, "cosine", COS)
    ri = np.array([r["ri"] for r in rows])
    for tol in (0.0, 7.0, 500.0):
        want = brute_top(d, np.abs(ri[:, None] - ri[None, :]) <= tol, 4)
        got = {i: [] for i in range(60)}
        for r in S.search_library(df, df, COS, 4, tol, fragment_only=True).orderBy("query_id", "rank").collect():
            got[int(r["query_id"][1:])].append(int(r["library_id"][1:]))
        assert got == want


def test_missing_ri_is_excluded_only_with_a_window(spark):
    df = make_spectra(spark, [("a", [(50, 1)], 100.0), ("b", [(50, 1)], None)], ["ri double"]).withColumn("frag", F.col("peaks"))
    assert S.search_library(df, df, COS, 5, 10.0, fragment_only=True).count() == 1
    assert S.search_library(df, df, COS, 5, fragment_only=True).count() == 4
    assert S.search_library(df.drop("ri"), df, COS, 5, 10.0, fragment_only=True).count() == 4


def test_ties_follow_library_order(spark):
    lib = make_spectra(spark, [("b", [(100, 1)]), ("a", [(100, 1)]), ("c", [(50, 1)])]).withColumn("frag", F.col("peaks"))
    q = lib.filter("id = 'a'")
    got = S.search_topk_rerank(q, lib, COS, "cosine", "ppm_wasserstein", 2, 2, fragment_only=True).orderBy("rank").collect()
    assert [r["library_id"] for r in got] == ["b", "a"]


@pytest.mark.parametrize("row,k,want", [([.2, np.inf, np.nan, .1], 3, [3, 0]), ([.1, .2, .1, .1], 3, [0, 2, 3])])
def test_best_k(row, k, want):
    assert list(best_k(np.array([row]), np.arange(4), k)[1]) == want


def test_rerank_with_full_first_pass_is_exact(spark):
    df = random_spectra(spark, 40, seed=3)
    p = Params(tol_ppm=15.0)
    d, _ = dense(df, "ppm_wasserstein", p)
    want = brute_top(d, ~np.eye(40, dtype=bool), 5)
    got = {}
    for r in S.search_topk_rerank(df, df, p, "cosine", "ppm_wasserstein", 40, 5, True, True).orderBy("q_pos", "rank").collect():
        got.setdefault(r["q_pos"], []).append(r["l_pos"])
    assert got == want
    with pytest.raises(ValueError):
        S.search_topk_rerank(df, df, p.with_(use_split_loss=True), "cosine", "cosine", 5, 5)


def test_square_table_mirrors_and_directional_does_not(spark):
    df = make_spectra(spark, [("a", [(50, .6), (75, .3), (100, .1)]), ("b", [(50.0001, .7), (100.0001, .3)])]).withColumn("frag", F.col("peaks"))
    def table(m):
        return {(r["q_pos"], r["l_pos"]): r["distance"] for r in S.distance_table(df, Params(distance_method=m), fragment_only=True).collect()}
    c, k = table("cosine"), table("composite")
    assert c[0, 1] == c[1, 0] and c[0, 0] == 0 and len(c) == 4
    assert k[0, 1] != k[1, 0] and k[0, 0] == 0
    with pytest.raises(ValueError):
        S.distance_table(df, COS, fragment_only=True, max_cells=3)


def test_components_equal_plain_distance(spark):
    p = Params(distance_method="cosine", use_split_loss=True, use_typical_loss=True, use_mref_confidence=True, use_extended_losses=True)
    b = build_channels(random_spectra(spark, 12), p).persist()
    full = S.distance_table(b, p, components=True).filter("q_pos < l_pos").collect()
    plain = {(r["q_pos"], r["l_pos"]): r["distance"] for r in S.distance_table(b, p).collect()}
    rows = spark.createDataFrame([(r["query_id"], r["q_pos"], r["library_id"], r["l_pos"]) for r in full], "query_id string, q_pos long, library_id string, l_pos long")
    pairs = {(r["q_pos"], r["l_pos"]): r for r in X.pair_breakdown(rows, b, b, p).collect()}
    for r in full:
        key = (r["q_pos"], r["l_pos"])
        assert plain[key] == pytest.approx(r["distance"], abs=1e-12) == pairs[key]["distance"]
        assert r["c_frag_total"] + r["c_loss_total"] == pytest.approx(1, abs=1e-9)


def test_bin_backend_close_to_pairs(spark):
    df = random_spectra(spark, 20)
    g = SP.BinGrid(35, 650, 2.0, 20.0)
    rows = SP.search_bins(df, df, COS, 1, g, use_loss=False).collect()
    assert all(r["library_id"] == r["query_id"] and abs(r["distance"]) < 1e-9 for r in rows)
    with pytest.raises(ValueError):
        SP.search_bins(df, df, Params(distance_method="entropy"), 1)
    with pytest.raises(ValueError):
        SP.distance_bins(df, df, COS.with_(max_dense_cells=10))


# --- LC ---------------------------------------------------------------------------

def lc_toy(spark):
    rows = [("q1", [(100, 2), (150, 1)], 300.0, 5.0, "POSITIVE", "[M+H]+", "20 eV"), ("q2", [(120, 2), (170, 1)], 300.002, 5.1, "pos", "[M+H]+", "22"),
            ("q3", [(140, 2), (190, 1)], 450.0, 9.0, "negative", "[M-H]-", "20")]
    return LC.as_lc_spectra(make_spectra(spark, rows, ["precursor_mz double", "rt double", "ion_mode string", "precursor_type string", "collision_energy string"]))


def test_lc_gates_and_audit(spark):
    s = lc_toy(spark)
    plan = LCSearchPlan(precursor_ppm=10, rt_window=.25, collision_energy_tolerance=3, require_adduct=True)
    a = LC.candidate_audit(s.filter("id = 'q1'"), s, plan).first()
    assert (a["initial"], a["final"]) == (3, 2)
    none = s.filter("id = 'q1'").withColumn("precursor_mz", F.lit(None).cast("double"))
    only = dict(require_ion_mode=False)
    assert LC.candidate_audit(none, s, LCSearchPlan(**only)).first()["final"] == 3
    assert LC.candidate_audit(none, s, LCSearchPlan(missing_metadata="exclude", **only)).first()["final"] == 0
    with pytest.raises(ValueError):
        LC.candidate_audit(none, s, LCSearchPlan(missing_metadata="error", **only))


@pytest.mark.parametrize("policy", ["allow", "exclude"])
def test_lc_search_equals_brute_force(spark, policy):
    df = random_spectra(spark, 60, seed=5, hot=.5)
    mode = F.when(F.col("pos") % 7 == 0, F.lit(None)).when(F.col("pos") % 2 == 0, "positive").otherwise("negative")
    df = df.withColumns({"ion_mode": mode, "adduct": F.lit("A"), "rt": F.lit(1.0), "collision_energy": F.lit(1.0),
                         "precursor_mz": F.when(F.col("pos") % 9 != 4, F.col("precursor_mz"))})
    plan = LCSearchPlan(precursor_ppm=40, missing_metadata=policy, first_pass_method="cosine", rerank_method="ppm_wasserstein", first_pass_top_k=60, final_top_k=4)
    p = lc_default_params(tol_ppm=15.0)
    d, rows = dense(df, "ppm_wasserstein", p)
    def ok(a, b):
        if a is None or b is None:
            return None
        return a == b
    keep = np.zeros_like(d, bool)
    for i, q in enumerate(rows):
        for j, r in enumerate(rows):
            mz = None if q["precursor_mz"] is None or r["precursor_mz"] is None else abs(r["precursor_mz"] - q["precursor_mz"]) / q["precursor_mz"] * 1e6 <= 40
            gates = [mz, ok(q["ion_mode"], r["ion_mode"])]
            keep[i, j] = all((policy == "allow") if g is None else g for g in gates)
    got = {i: [] for i in range(60)}
    for r in LC.search_lc_library(df, df, plan, p).orderBy("q_pos", "rank").collect():
        got[r["q_pos"]].append(r["l_pos"])
    assert got == brute_top(d, keep, 4)
    audit = {r["query_id"]: r["final"] for r in LC.candidate_audit(df, df, plan).collect()}
    assert [audit[r["id"]] for r in rows] == list(keep.sum(1))


def test_strict_lc_input(spark):
    bad = make_spectra(spark, [("a", [(1, 1)]), ("a", [(2, 1)])])
    with pytest.raises(ValueError):
        LC.as_lc_spectra(bad)
    with pytest.raises(ValueError):
        LC.as_lc_spectra(make_spectra(spark, [("a", [(0, 1)])]))


# --- metrics ------------------------------------------------------------------------

def pair_frame(spark, d, keys):
    n = len(d)
    rows = [(str(i), i, str(j), j, float(d[i][j]), keys[i], keys[j]) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "query_id string, q_pos long, library_id string, l_pos long, distance double, q_key string, l_key string")


def test_fdr_and_transforms(spark):
    d = [[0, .4, 1.7], [.4, 0, -.2], [1.7, -.2, 0]]
    x = pair_frame(spark, d, ["k", "k", "z"])
    raw = sorted(r["similarity"] for r in M.unordered_pairs(x).collect())
    assert np.allclose(raw, [-.7, .6, 1.2])
    f = M.fdr_curve(M.unordered_pairs(x, "minmax")).orderBy("threshold").first()
    assert (f["n_matches"], f["n_true_pos"], f["n_false_pos"], f["fdr"]) == (2, 1, 1, .5)
    none = M.fdr_curve(M.unordered_pairs(pair_frame(spark, d, [None, None, None]))).first()
    assert none["fdr"] is None
    assert M.fdr_curve(M.unordered_pairs(x, "linear"), thresholds=(5.0,)).first()["fdr"] == 0


def test_auc_with_ties(spark):
    x = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (0.5, False)], "score double, positive boolean")
    assert M.rank_auc(x).first()["auc"] == pytest.approx(.875) == M.roc_auc(x).first()["auc"]
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 300, 3000), rng.random(3000) < .3
    big = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "score double, positive boolean")
    want = np.mean([(a > s[~y]).mean() + .5 * (a == s[~y]).mean() for a in s[y]])
    assert M.rank_auc(big).first()["auc"] == pytest.approx(want, abs=1e-12)
    ends = M.roc_points(big).filter("abs(threshold) > 1e300").collect()
    assert sorted((r["tpr"], r["fpr"]) for r in ends) == [(0, 0), (1, 1)]


def test_retrieval_with_nonfinite(spark):
    q = spark.createDataFrame([(0, "A")], "pos long, key string")
    lib = spark.createDataFrame([(i, "A" if i < 4 else "B") for i in range(5)], "pos long, key string")
    d = [.1, math.inf, math.nan, -math.inf, .2]
    s = spark.createDataFrame([("q", 0, str(i), i, v) for i, v in enumerate(d)], "query_id string, q_pos long, library_id string, l_pos long, distance double")
    r = M.library_retrieval(s, q, lib).first()
    assert (r["map"], r["mrr"], r["p_at_5"], r["n_queries"]) == (.25, 1, .5, 1)
    r = M.library_retrieval(s.limit(0), q, lib).first()
    assert (r["map"], r["mrr"], r["p_at_1"], r["n_queries"]) == (0, 0, 0, 1)


def test_fractional_ties(spark):
    x = spark.createDataFrame([(0, 0.0, True), (0, 0.0, False)], "q_pos long, distance double, relevant boolean")
    r = M.tie_aware_queries(x).first()
    assert (r["top1_optimistic"], r["top1_fractional"], r["top1_pessimistic"], r["rr_fractional"]) == (1, .5, 0, .75)
    y = spark.createDataFrame([(0, 0.0, True), (0, 0.0, True), (0, 0.0, False)], "q_pos long, distance double, relevant boolean")
    r = M.tie_aware_precision(y, k_values=(1, 2, 3)).first()
    # expected value over all orders of two relevant and one irrelevant entry
    assert r["average_precision"] == pytest.approx(np.mean([1, 5 / 6, 7 / 12]))
    assert [r[f"p_at_{k}"] for k in (1, 2, 3)] == pytest.approx([2 / 3] * 3)


def test_replicates_and_homologs(spark):
    rows = [("A", [(50, .5), (100, .5)], 100.0, "AAAAAAAAAAAAAA-B", "alkane"), ("B", [(50, .52), (100, .48)], 220.0, "AAAAAAAAAAAAAA-B", "alkane"),
            ("C", [(70, .5), (150, .5)], 450.0, "ZZZZZZZZZZZZZZ-D", "aromatic")]
    df = make_spectra(spark, rows, ["ri double", "inchikey string", "compound_class string"]).withColumn("frag", F.col("peaks"))
    c = M.replicate_consistency(M.replicate_ranks(df, COS, fragment_only=True)).first()
    assert (c["top1_accuracy"], c["mrr"], c["n_queries"]) == (1, 1, 2)
    h = M.homolog_detection(df, COS, fragment_only=True).first()
    assert (h["n_pairs"], h["n_true"], h["homolog_score"]) == (1, 1, 1)


def test_motif_overlap_identity(spark):
    """Rank form of the mean pairwise minimum equals the pair loop."""
    rng = np.random.default_rng(1)
    v = np.round(rng.random(9) * (rng.random(9) < .7), 6)
    rows = [(str(i), i, "1", [(15.0235, float(x), "CH3")] if x > 0 else []) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id string, pos long, cluster string, loss_typ array<struct<mz:double,intensity:double,formula:string>>")
    r = X.typical_motifs(df, Params().base_losses).filter("formula = 'CH3'").first()
    want = np.mean([min(v[i], v[j]) for i in range(9) for j in range(i)])
    assert r["pairwise_overlap"] == pytest.approx(want) and r["sd_intensity"] == pytest.approx(v.std(ddof=1))


# --- clusters -------------------------------------------------------------------------

def test_connected_groups(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 130)]
    nodes = sorted({x for e in edges for x in e} | {999})
    parent = {n: n for n in nodes}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = CL.connected_groups(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r["node"]: r["group"] for r in got.collect()} == {n: find(n) for n in nodes}


def test_density_clusters(spark):
    rows = [(f"a{i}", [(50, 1), (60, .1 * i)]) for i in range(1, 4)] + [(f"b{i}", [(90, 1), (95, .1 * i)]) for i in range(1, 4)] + [("n", [(200, 1)])]
    df = make_spectra(spark, rows).withColumn("frag", P.tic_normalize(F.col("peaks")))
    got = {r["id"]: r["cluster"] for r in CL.cluster_density(df, COS, .2, 2, True).collect()}
    assert got == {"a1": "1", "a2": "1", "a3": "1", "b1": "2", "b2": "2", "b3": "2", "n": "0"}


def test_density_clusters_with_ri_penalty(spark):
    rows = [(f"a{i}", [(50, 1), (60, .1 * i)]) for i in range(6)]
    df = make_spectra(spark, rows).withColumn("frag", P.tic_normalize(F.col("peaks")))
    far = df.withColumn("ri", F.when(F.col("pos") < 3, 1000.0).when(F.col("pos") < 5, 1200.0).cast("double"))
    of = lambda x, p: [r["cluster"] for r in CL.cluster_density(x, p, .3, 2, True).orderBy("pos").collect()]
    hard, soft = COS.with_(ri_mode_cluster="hard"), COS.with_(ri_mode_cluster="soft")
    assert of(far, COS) == ["1"] * 6
    split = far.filter("pos < 5")  # a missing index is no penalty, so the last spectrum would join both halves
    assert of(split, hard) == of(split, soft) == ["1", "1", "1", "2", "2"] and of(far, hard) == ["1"] * 6
    assert of(df, hard) == ["1"] * 6
    with pytest.raises(ValueError):
        CL.cluster_density(df, COS, min_pts=7)
    with pytest.raises(ValueError):
        CL.cluster_density(df.limit(1), COS)


def test_no_auc_below_three_spectra(spark):
    rows = spark.createDataFrame([(0, 1, 0.2, True)], "q_pos long, l_pos long, distance double, positive boolean")
    assert tuple(M.auc_roc(rows, n_spectra=2).first()) == (None, 0, 0)
    assert tuple(M.auc_roc(rows, n_spectra=3).first()) == (None, 1, 0)


# --- statistics -------------------------------------------------------------------------

def test_statistics(spark):
    assert ST.exact_mcnemar(0, 0) == 1 and ST.exact_mcnemar(1, 9) == pytest.approx(22 / 1024)
    x = spark.createDataFrame([(g, u, float(u % 5)) for g in "ab" for u in range(200)], "g string, u long, v double")
    a, b = (ST.bootstrap_ci(x.repartition(n), "v", ["g"], unit="u", n_boot=200).orderBy("g").collect() for n in (1, 5))
    for r, s in zip(a, b):
        assert r["mean"] == 2 and 1.7 < r["ci_low"] < 2 < r["ci_high"] < 2.3
        assert r["ci_low"] == pytest.approx(s["ci_low"])
    q = spark.createDataFrame([([1.0, 2.0, 3.0, 10.0],)], "v array<double>").select(ST.quantile_unbiased(F.col("v"), .3).alias("x")).first()["x"]
    assert q == pytest.approx(np.quantile([1, 2, 3, 10], .3, method="median_unbiased"))


def test_params():
    with pytest.raises(ValueError, match="bin_ppm"):
        Params().with_(binppm=1)
    for bad in (dict(distance_method="x"), dict(max_mz=1.0), dict(noise_thr=2.0), dict(topK=0), dict(w_frag=0.0, w_loss=0.0), dict(smear_kind="x")):
        with pytest.raises(ValueError):
            Params().with_(**bad).validate()
    for odd in (dict(w_frag=.5), dict(loss_max_peaks=5), dict(loss_typical_conf_gamma=0.0)):
        with pytest.warns(UserWarning):
            Params().with_(**odd).validate()
    with pytest.raises(ValueError):
        LCSearchPlan(final_top_k=60)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        Params().validate()


def test_unique_ids_avoid_taken_suffixes(spark):
    rows = [(1, "a"), (2, "a"), (3, "a__1"), (4, "a"), (5, None), (6, "a__1"), (7, "a__4"), (8, "a")]
    out = [r["id"] for r in LC.unique_ids(spark.createDataFrame(rows, "pos long, name string")).orderBy("pos").collect()]
    assert out == ["a", "a__2", "a__1", "a__3", "entry_5", "a__1__1", "a__4", "a__5"]
