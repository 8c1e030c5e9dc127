"""Closed forms of tie statistics against plain sums, and ties of a million rows."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import metrics as M
from peakloom.operators import ties as T

def ends():
    return [F.col(c) for c in ("before", "size", "hits")]


def chances(n, h):
    """P(R = r) for r = 0..n-h."""
    p, out = h / n, []
    for r in range(n - h + 1):
        out.append(p)
        p *= (n - h - r) / max(1, n - 1 - r)
    return np.array(out)


def blocks(spark, rows):
    return spark.createDataFrame(rows, "before long, size long, hits long")


def test_closed_forms(spark):
    rows = [(b, n, h) for b in (0, 3, 40) for n in (1, 2, 9, 17, 60) for h in {1, min(2, n), n // 2 or 1, n}]
    rows += [(0, 9000, 1), (7, 20000, 3), (2, 20000, 19000), (100000, 30000, 2), (0, 300000, 1)]
    B, N, H = ends()
    x = blocks(spark, rows).select("before", "size", "hits", T.expected_reciprocal(B, N, H).alias("rr"), T.harmonic(B, N).alias("sum"),
                                   T.none_among(F.lit(4), N, H).alias("none"), *[T.chance_within(k, B, N, H).alias(f"c{k}") for k in (1, 5, 10)])
    for r in x.collect():
        b, n, h = r["before"], r["size"], r["hits"]
        p = chances(n, h)
        rank = b + 1 + np.arange(len(p))
        assert r["rr"] == pytest.approx((p / rank).sum(), abs=2e-8, rel=1e-6 if n > 4096 else 1e-12)
        assert r["sum"] == pytest.approx(math.fsum(1 / (b + i) for i in range(1, n + 1)), rel=1e-13)
        assert r["none"] == pytest.approx(p[4:].sum(), abs=1e-7)
        for k in (1, 5, 10):
            assert r[f"c{k}"] == pytest.approx(p[rank <= k].sum(), abs=1e-12)


def test_draws_follow_the_chances(spark):
    _, N, H = ends()
    x = spark.range(40000).select(((F.col("id") + 0.5) / 40000).alias("u"), F.lit(12).alias("size"), F.lit(3).alias("hits"))
    got = {r["r"]: r["count"] / 40000 for r in x.select(T.drawn_offset(F.col("u"), N, H).alias("r")).groupBy("r").count().collect()}
    assert [got.get(r, 0) for r in range(10)] == pytest.approx(chances(12, 3), abs=1e-4)
    one = x.limit(1).select(T.drawn_offset(F.lit(0.0), F.lit(5), F.lit(5)).alias("a"), T.drawn_offset(F.lit(1e-12), F.lit(10 ** 6), F.lit(1)).alias("b")).first()
    assert one["a"] == 0 and one["b"] == 10 ** 6 - 1


def test_a_million_tied_rows(spark):
    x = spark.range(1_000_000).select(F.lit(0).alias("q_pos"), F.col("id").alias("l_pos"), F.lit(0.5).alias("distance"), (F.col("id") < 2).alias("relevant"))
    start = time.perf_counter()
    first = M.tie_aware_queries(x).first()
    precision = M.tie_aware_precision(x).first()
    target = M.single_target_metrics(x, spark.createDataFrame([(0, 7)], "q_pos int, l_pos long")).first()
    assert time.perf_counter() - start < 60
    n = 1_000_000
    all_ = math.fsum(1 / i for i in range(1, n + 1))
    assert first["worst_rank"] == n - 1 and first["top1_fractional"] == pytest.approx(2 / n)
    assert first["rr_fractional"] == pytest.approx(math.fsum(2 * (n - i) / (n * (n - 1)) / i for i in range(1, n)), rel=1e-5)
    assert precision["average_precision"] == pytest.approx(math.fsum((1 + (j - 1) / (n - 1)) / j for j in range(1, n + 1)) / n, rel=1e-9)
    assert target["rr_fractional"] == pytest.approx(all_ / n, rel=1e-12)


def lists(spark, rows):
    return spark.createDataFrame(rows, "q_pos long, distance double, relevant boolean")


def test_sensitivity_and_effects(spark):
    fine = lists(spark, [(0, .1, True), (0, .1, False), (0, .2, True), (1, .1, False), (1, .3, True), (2, .1, False), (3, .5, True), (3, .5, True)])
    coarse = lists(spark, [(0, .1, True), (0, .1, True), (1, .1, True), (1, .3, True), (2, .1, False)])
    out = {(r["metric"], r["tie_policy"]): (r["estimate"], r["n_queries"]) for r in T.tie_sensitivity(fine, coarse, seed=3).collect()}
    assert len(out) == 20
    assert out["top1", "optimistic"] == (pytest.approx(2 / 3), 3) and out["top1", "pessimistic"] == (pytest.approx(1 / 3), 3)
    assert out["top1", "fractional"][0] == pytest.approx(.5) and out["mrr", "fractional"][0] == pytest.approx((.75 + .5 + 1) / 3)
    assert out["p_at_1", "fractional"] == (1, 2)
    assert out["mrr", "pessimistic"][0] <= out["mrr", "random"][0] <= out["mrr", "optimistic"][0]
    rows = {r["metric"]: r for r in T.tie_effects(fine, coarse).collect()}
    top = rows["top1"]
    assert (top["n_queries_evaluated"], top["n_with_relevant_tie"], top["n_tie_blocks_crossing_cutoff"], top["n_affected"], top["n_tied_not_affected"]) == (3, 2, 2, 1, 1)
    assert (rows["top5"]["n_affected"], rows["p_at_1"]["n_tie_blocks_crossing_cutoff"], rows["p_at_1"]["n_affected"]) == (0, 1, 0)


def test_no_query_with_a_relevant_entry(spark):
    none = lists(spark, [(0, .1, False)])
    for x in (none, none.limit(0)):
        assert {(r["estimate"], r["n_queries"]) for r in T.tie_sensitivity(x).collect()} == {(None, 0)}
        assert {(r["n_queries_evaluated"], r["proportion_affected"]) for r in T.tie_effects(x).collect()} == {(0, None)}
