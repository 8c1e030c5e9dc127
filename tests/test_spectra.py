"""Per-spectrum operators on hand cases."""

import numpy as np
import pytest
from conftest import make_spectra
from pyspark.sql import functions as F

from peakloom import Params
from peakloom import constants as C
from peakloom.functions import peaks as P
from peakloom.functions.derived import difference_channels
from peakloom.functions.ragged import Batch
from peakloom.operators import noise as N
from peakloom.operators import spectra as S


def peaks(row):
    return [(p["mz"], p["intensity"]) for p in row]


def one(spark, pk, expr):
    return make_spectra(spark, [("a", pk)]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [
    ("50:1 40:2", [(40, 2), (50, 1)]), ("", []), (None, []), ("x:1 50:y 60:0 -1:5 70:3", [(70, 3)]), ("5:NaN 6:Infinity 7:1", [(7, 1)])])
def test_parse(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(P.parse_peaks(F.col("t")).alias("x"))
    assert peaks(df.first()["x"]) == want


def slow_prep(pk, p):
    pk = [x for x in pk if p.min_mz <= x[0] <= p.max_mz]
    if not pk:
        return []
    top = max(x[1] for x in pk)
    pk = sorted(x for x in pk if x[1] >= top * p.noise_thr)
    out = []
    while pk:
        grp = [x for x in pk if x[0] - pk[0][0] <= pk[0][0] * p.centroid_ppm * 1e-6]
        s = sum(x[1] for x in grp)
        out.append((sum(x[0] * x[1] for x in grp) / s, s))
        pk = pk[len(grp):]
    out = sorted(sorted(out, key=lambda x: -x[1])[:p.topK])
    s = sum(x[1] for x in out)
    return [(m, v / s) for m, v in out]


def test_prep_matches_slow_form(spark):
    rng = np.random.default_rng(0)
    p = Params(centroid_ppm=2000.0, topK=8)
    rows = [(str(i), list(zip(rng.uniform(30, 45, 25), rng.random(25) * 100 + 1))) for i in range(20)] + [("e", [])]
    got = make_spectra(spark, rows).select("id", P.prep_peaks(F.col("peaks"), p).alias("x")).collect()
    for (_, raw), r in zip(rows, sorted(got, key=lambda r: (r["id"] == "e", int(r["id"]) if r["id"] != "e" else 0))):
        assert np.allclose(peaks(r["x"]) or np.zeros((0, 2)), slow_prep(raw, p) or np.zeros((0, 2)), atol=1e-12)


def test_sqrt_option(spark):
    x = peaks(one(spark, [(50, 1), (60, 9)], P.prep_peaks(F.col("peaks"), Params(use_sqrt=True))))
    assert x == [(50, .25), (60, .75)]


def test_anchored_differences_with_reference(spark):
    p = Params(loss_min=30, loss_max=90, loss_max_peaks=2, min_mz=1)
    df = make_spectra(spark, [("a", [(50, .4), (75, .3), (100, .2), (140, .1)])])
    r = S.build_channels(df, p, reference_mz=140.0).first()
    assert [m for m, _ in peaks(r["loss_anchor"])] == [65, 90]
    assert np.allclose([v for _, v in peaks(r["loss_anchor"])], [3 / 7, 4 / 7])


def test_loss_downweighting_changes_the_kept_peak(spark):
    df = make_spectra(spark, [("a", [(300, .2), (209.9499, 1), (240, .9), (250, .8)])])
    base = Params(loss_max_peaks=1, loss_top_peaks=1, derivatization_mode="manual", noise_thr=0.0)
    for weight, want in ((1.0, 90.05), (0.01, 60.0)):
        p = base.with_(derivatization_raw_loss_weight=weight)
        x = peaks(S.build_channels(df, p, reference_mz=300.0).first()["loss_anchor"])
        assert x[0][0] == pytest.approx(want, abs=1e-3)


def test_reference_mass(spark):
    df = make_spectra(spark, [("a", [(181.9894, .06), (200, .03), (91.0548, .20)])])
    assert S.build_channels(df, Params(noise_thr=0.0)).first()["estimated_Mref"] == pytest.approx(200, abs=.01)


def test_derivatization_detection(spark):
    pk = [(73.0474, 100), (147.0654, 30), (91.0548, 500), (43.0548, 370)]
    df = make_spectra(spark, [("a", pk)])
    p = Params(derivatization_mode="auto", derivatization_type="BOTH")
    assert S.build_channels(df, p).first()["derivatization_type"] == "TMS"


def test_array_form_equals_batch_form(spark):
    """The expression twin of the difference spectra gives the batch kernel's numbers."""
    rng = np.random.default_rng(4)
    p = Params(loss_top_peaks=10, loss_max_peaks=20)
    rows = [(str(i), list(zip(np.sort(rng.uniform(40, 300, 15)), rng.random(15)))) for i in range(6)]
    df = make_spectra(spark, rows).withColumn("frag", P.prep_peaks(F.col("peaks"), p))
    got = df.select("pos", "frag", P.summarize_differences(P.pairwise_differences(F.col("frag"), p), p).alias("x")).orderBy("pos").collect()
    frag = Batch.from_lists([peaks(r["frag"]) for r in got])
    top = np.array([max(m for m, _ in peaks(r["frag"])) for r in got])
    _, _, pair = difference_channels(frag, top, np.ones(6), [], p)
    for i, r in enumerate(got):
        s = slice(pair.off[i], pair.off[i + 1])
        assert np.allclose(peaks(r["x"]), np.column_stack([pair.mz[s], pair.it[s]]), atol=1e-12)


def test_typical_projection_takes_the_nearest(spark):
    losses = P.loss_table(C.CORE_LOSSES)
    x = one(spark, [(15.0236, .5), (18.0107, .25), (99, .25)], P.project_typical(F.col("peaks"), losses, 20.0))
    assert [(r["formula"], round(r["intensity"], 6)) for r in x] == [("CH3", .666667), ("H2O", .333333)]
    assert one(spark, [(99, 1)], P.project_typical(F.col("peaks"), losses, 20.0)) == []


@pytest.mark.parametrize("pk,want", [
    ([], "unknown"), ([(200, 1)], "unclassified"),
    ([(43.0548, .2), (57.0704, .3), (71.0861, .2), (85.1017, .2), (99.1174, .1)], "alkane"),
    ([(91.0548, .6), (77.0391, .1), (300, .3)], "alkylbenzene;aromatic"),
    ([(43.0184, .5), (58.0419, .2), (61.0290, .3)], "methyl_ketone;acetate_ester"),
    ([(43.0184, .5), (300, .5)], "acetyl_compound"),
    ([(31.0184, .2), (45.0340, .2), (300, .6)], "alcohol"),
    ([(46.9955, .2), (300, .8)], "sulfur_compound"),
    ([(68.0262, .4), (39.0235, .4), (300, .2)], "furan")])
def test_classes(spark, pk, want):
    assert one(spark, pk, P.detect_class(F.col("peaks"))) == want


def test_default_range_hides_light_ions(spark):
    frag = P.prep_peaks(F.col("peaks"), Params())
    assert one(spark, [(31.0184, .2), (45.0340, .2), (300, .6)], P.detect_class(frag)) == "unclassified"


def test_frequency_and_weights(spark):
    df = make_spectra(spark, [("a", [(50.2, .5), (50.4, .5)]), ("b", [(50.1, 1)]), ("c", [])]).withColumn("frag", F.col("peaks"))
    f = S.mz_frequency(df)
    assert [(r["mz_bin"], round(r["frequency"], 4)) for r in f.collect()] == [(50.5, .6667)]
    w = S.weight_spectra(df, f).orderBy("pos").collect()
    assert np.allclose([v for _, v in peaks(w[0]["frag"])], [.5, .5]) and peaks(w[2]["frag"]) == []


def test_mixture_tic_split(spark):
    sig, noi = [(100, 3), (110, 1)], [(200, 1), (210, 1)]
    df = make_spectra(spark, [("a", sig)]).withColumn("noise", F.array(*[P.peak(F.lit(float(m)), F.lit(float(v))) for m, v in noi]))
    r = N.mix_columns(df, "peaks", "noise", 0.2, 0.0).first()
    x = peaks(r["mixture"])
    assert sum(v for m, v in x if m < 150) == pytest.approx(.2) and sum(v for m, v in x if m > 150) == pytest.approx(.8)
    assert r["signal_tic_fraction"] == pytest.approx(.2)


def test_perturbation_contract(spark):
    df = make_spectra(spark, [(str(i), [(100 + j, 1 + j) for j in range(9)]) for i in range(5)]).withColumn("frag", F.col("peaks"))
    run = lambda n, **kw: [peaks(r["frag"]) for r in N.perturb_spectra(df.repartition(n), **kw).orderBy("pos").collect()]
    assert run(1) == [peaks(r["frag"]) for r in df.orderBy("pos").collect()]
    noisy = dict(mz_noise_ppm=10.0, intensity_noise_sd=.2, dropout_prob=.3, seed=9)
    assert run(1, **noisy) == run(4, **noisy) != run(1, **{**noisy, "seed": 10})
    with pytest.raises(ValueError):
        N.perturb_spectra(df, dropout_prob=1.5)


def test_partners_avoid_self_and_repeat_only_when_short(spark):
    df = make_spectra(spark, [(str(i), [(100 + i, 1)]) for i in range(7)])
    got = N.choose_partners(df, df, 3, seed=4).collect()
    assert len(got) == 21 and all(r["pos"] != r["noise_pos"] for r in got)
    with pytest.raises(ValueError):
        N.choose_partners(df.filter("pos = 0"), df.filter("pos = 0"), 1, seed=1)


def test_anchor_shift_keeps_pairwise(spark):
    df = make_spectra(spark, [(str(i), [(100 + 3 * j + i, 1 + j) for j in range(8)]) for i in range(3)])
    b = S.build_channels(df, Params())
    s = N.shift_anchor(b, 0.01, Params()).select("pos", F.col("loss_pair").alias("p2"), F.col("loss_anchor").alias("a2"))
    rows = b.join(s, "pos").collect()
    assert all(r["loss_pair"] == r["p2"] and r["loss_anchor"] != r["a2"] for r in rows)
