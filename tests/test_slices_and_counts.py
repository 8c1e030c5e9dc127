"""Work held at once is bounded: differences by slice, threshold and gate counts inside the cells."""

import numpy as np
from conftest import make_spectra
from pyspark.sql import functions as F

from peakloom.operators import lc, metrics, spectra
from peakloom.params import LCSearchPlan, Params


def test_differences_do_not_depend_on_the_slice(spark, monkeypatch):
    rng = np.random.default_rng(2)
    raw = make_spectra(spark, [(f"s{i}", [(60 + 7 * j, float(rng.uniform(1, 9))) for j in range(5)]) for i in range(40)]).coalesce(1)
    p = Params(use_typical_loss=True)
    whole = {r.id: r for r in spectra.build_channels(raw, p).collect()}
    real = spectra.difference_channels
    monkeypatch.setattr(spectra, "SLICE", 7)

    def watched(frag, *rest):
        assert len(frag) <= 7
        return real(frag, *rest)

    monkeypatch.setattr(spectra, "difference_channels", watched)
    got = {r.id: r for r in spectra.build_channels(raw, p).collect()}
    assert got == whole


def test_fdr_counts_equal_the_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{i}", [(50 + 5 * j, float(rng.uniform(0, 9))) for j in range(4)], None if i % 9 == 0 else "ABCDEFGHIJKLMN"[:13] + str(i % 3))
            for i in range(60)]
    s = make_spectra(spark, rows, ["inchikey string"]).withColumn("frag", F.col("peaks"))
    p = Params(distance_method="cosine")
    want = metrics.fdr_curve(metrics.to_similarity(metrics.scored_pairs(s, p, fragment_only=True), "minmax")).collect()
    got = metrics.fdr_of_spectra(s, p, fragment_only=True, cell=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    none = metrics.fdr_of_spectra(s.filter("inchikey is null"), p, fragment_only=True).collect()
    assert len(none) == 10 and all(r.fdr is None and r.n_matches == 0 for r in none)


def test_audit_counts_equal_the_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i % 70}", i, float(np.exp(rng.uniform(5, 5.01))) if i % 11 else None, "PN"[i % 2] if i % 13 else None,
             float(rng.uniform(0, 9))) for i in range(90)]
    s = spark.createDataFrame(rows, "id string, pos long, precursor_mz double, ion_mode string, rt double")
    plan = LCSearchPlan(precursor_ppm=900.0, rt_window=3.0, require_ion_mode=True, exclude_same_id=True, missing_metadata="exclude")
    counts, names = lc.banded_counts(s, s, plan)
    pairs = lc.gated_pairs(s, s, plan)
    want = {r.q_pos: r.n for r in pairs.groupBy("q_pos").agg(F.count("*").alias("n")).collect()}
    assert {r.q_pos: r.final for r in counts.collect() if r.final} == want
    plan_text = lc.candidate_audit(s, s, plan)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "CoGroupsInArrow" in plan_text and names[-1] == "final"
