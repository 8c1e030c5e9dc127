"""Whole runs, streaming, and the shape of the registered queries' plans."""

import os

import pytest
from conftest import make_spectra
from pyspark.sql import functions as F

from peakloom import Params
from peakloom.operators import benchmark as B
from peakloom.operators import deriv as DV
from peakloom.operators import design as DS
from peakloom.operators import plotdata as PD
from peakloom.operators import search as S
from peakloom.operators.spectra import build_channels
from peakloom.plans import catalog, oracle, pipeline
from peakloom.sources.demo import generate_demo_msdial
from peakloom.streaming.search import search_stream

SMALL = "/root/testdata/sf0.001"
COS = Params(distance_method="cosine")


def test_full_run(spark, tmp_path):
    p = Params(distance_method="cosine", use_typical_loss=True, ri_mode_cluster="soft")
    out = pipeline.run_similarity(spark, generate_demo_msdial(spark, 8, 6), p, str(tmp_path / "run"))
    n = out["spectra"].count()
    assert n > 0 and out["similarity"].count() == n * n
    assert out["clusters"].count() == n == out["coordinates"].count()
    assert {"similarity", "clusters", "analog_graph", "reports"} <= set(os.listdir(tmp_path / "run"))
    wide = pipeline.to_wide(out["similarity"], "sim_raw")
    assert len(wide.columns) == n + 1
    with pytest.raises(ValueError):
        pipeline.to_wide(out["similarity"], "sim_raw", 3)
    with pytest.raises(ValueError):
        pipeline.options(blank_facto=2)


def test_explained_clusters(spark):
    rows = [(f"a{i}", [(50, 1), (77, .5), (100 + i, .2), (150, .4)]) for i in range(4)] + [(f"b{i}", [(60, 1), (88, .5), (140 + i, .2)]) for i in range(3)]
    df = build_channels(make_spectra(spark, rows), COS).withColumns({
        "cluster": F.when(F.col("id").startswith("a"), "1").otherwise("2"), "known": F.lit("T"), "ri": F.col("pos") + 0.0,
        "compound_class": F.lit("x")})
    from peakloom.operators import explain as X
    drivers = {r["cluster"]: r for r in X.cluster_drivers(df, COS).collect()}
    assert drivers["1"]["n"] == 4 and drivers["2"]["RI_median"] == 5
    table = {(r["q_pos"], r["l_pos"]): r["distance"] for r in S.distance_table(df, COS).collect()}
    means = {i: sum(table[i, j] for j in range(4) if j != i) / 3 for i in range(4)}
    assert drivers["1"]["medoid_id"] == f"a{min(means, key=means.get)}"
    part = X.medoid_partners(df, COS, X.medoids(X.within_cluster_sums(df, COS)), within=2, outside=1)
    kinds = [(r["cluster"], r["kind"]) for r in part.collect()]
    assert kinds.count(("1", "within_top")) == 2 and kinds.count(("1", "outside_top")) == 1 and kinds.count(("2", "within_worst")) == 1


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(f"s{i}", [(50 + i % 3, 1), (90 + i % 2, .5), (120 + i, .3)]) for i in range(12)]
    raw = make_spectra(spark, rows)
    lib = build_channels(raw, COS).persist()
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = search_stream(stream, lib, COS, str(tmp_path / "out"), str(tmp_path / "ck"), 3)
    q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).select("query_id", "rank", "library_id").collect()
    want = S.search_library(lib, lib, COS, 3).select("query_id", "rank", "library_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_rule_evaluation(spark):
    x = spark.createDataFrame([("tms", .1, .05, 0.0, 0.0), ("MTBSTFA", 0.0, 0.0, .1, .1), (None, .01, 0.0, None, 0.0), ("BOTH", .1, .1, .2, .2)],
                              "truth string, deriv_i73 double, deriv_i147 double, deriv_i115 double, deriv_i57 double")
    out = DV.run_evaluation(x, "truth")
    r = out["metrics"].first()
    assert r["recall_TMS"] == 1 and r["recall_TBDMS"] == 1 and r["accuracy"] == .75  # BOTH is no level: counts as none
    assert out["sweep"].count() == 99 and out["confusion"].agg(F.sum("n")).first()[0] == 4


def test_design_helpers(spark):
    rows = [(f"s{i}", [(50, 1), (60, 1)] if i else [(50, 1)], 100.0 + 3 * i, "ABCDEFGHIJKLMN-x" if i % 2 else "ZYXWVUTSRQPONM") for i in range(8)]
    df = make_spectra(spark, rows, ["ri double", "inchikey string"]).withColumn("frag", F.col("peaks"))
    assert DS.valid_spectra(df).count() == 7
    got = DS.ri_interferents(df, df, 10.0, 2).collect()
    ri = {i: 100.0 + 3 * i for i in range(8)}
    assert all(r["pos"] != r["noise_pos"] and abs(ri[r["pos"]] - ri[r["noise_pos"]]) <= 10 for r in got)
    assert all((r["pos"] + r["noise_pos"]) % 2 for r in got if 1 <= r["pos"] <= 6)  # another compound first
    assert DS.controlled_subset(df, df.select("id"), 3).count() == 6


def test_plot_tables_and_sweep(spark):
    rows = [(f"s{i}", [(50 + i % 2, 1), (90, .5)], f"{'AB'[i % 2] * 14}-k") for i in range(6)]
    raw = make_spectra(spark, rows, ["inchikey string"])
    out = B.sweep_params(raw, COS, {"noise_thr": [0.01, 0.6]}, ["cosine", "hellinger"])
    assert out.select("setting", "method").distinct().count() == 4
    ranks = PD.benchmark_rows(out.filter("setting = 0"))
    assert ranks.filter("metric = 'mrr'").count() == 2
    with pytest.raises(ValueError):
        B.sweep_params(raw, COS, {"noise_threshold": [1]}, ["cosine"])
    b = build_channels(raw, COS)
    rob = B.noise_robustness(b, COS, ["cosine"], (0.0,), 1, top_k=3).first()
    assert rob["topk_accuracy"] == 1 and rob["n_queries"] == 6


def test_every_oracle_has_a_query():
    assert set(oracle.all_sql()) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["library_search", "ri_band_search", "lc_candidate_audit", "lc_search", "analog_graph", "auc_roc",
                                  "cluster_motifs", "typical_match_table", "quant_pipeline", "mixture_seeded"])
def test_plans_have_no_nested_loop(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_scan_reads_only_needed_columns(spark):
    df = catalog.QUERIES["nonzero_filter"](spark, SMALL)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    line = next(x for x in plan.splitlines() if "ReadSchema" in x and "l_quantity" in x)
    assert "l_extendedprice" not in line and "l_shipdate" not in line
