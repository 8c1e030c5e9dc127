"""Long tables behind the figures (no drawing happens here)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .noise import mirror_long


def mirror(pairs: DataFrame, a: str, b: str, ppm: float = 20.0, mode: str = "max") -> DataFrame:
    return mirror_long(pairs, a, b, ppm, mode)


def contribution_rows(breakdown: DataFrame) -> DataFrame:
    """Stacked-bar rows per pair with the label midpoint of every segment."""
    cols = [c for c in breakdown.columns if c.startswith("c_")]
    x = breakdown.unpivot(["query_id", "library_id"], cols, "component", "share")
    w = Window.partitionBy("query_id", "library_id").orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    top = F.sum("share").over(w)
    return x.withColumn("midpoint", top - F.col("share") / 2)


def heatmap_rows(similarity: DataFrame, clusters: DataFrame, value: str = "sim_raw") -> DataFrame:
    """Tiles ordered by cluster, then by mean similarity to the own cluster."""
    c = clusters.select("pos", "cluster")
    x = similarity.join(c.toDF("q_pos", "q_cluster"), "q_pos").join(c.toDF("l_pos", "l_cluster"), "l_pos")
    own = x.groupBy("q_pos", "q_cluster").agg(
        F.avg(F.when(F.col("q_cluster") == F.col("l_cluster"), F.col(value))).alias("m"))
    return x.join(own.select("q_pos", "m"), "q_pos").select(
        "query_id", "library_id", F.struct("q_cluster", -F.col("m"), "q_pos").alias("order_key"), F.col(value).alias("value"))


def umap_rows(coordinates: DataFrame, labels: DataFrame) -> DataFrame:
    return coordinates.join(labels, "pos", "left")


def benchmark_rows(long_metrics: DataFrame) -> DataFrame:
    """Method comparison: every metric with its rank among methods."""
    w = Window.partitionBy("metric").orderBy(F.desc_nulls_last("value"))
    return long_metrics.withColumn("method_rank", F.rank().over(w))


def fdr_rows(curves: DataFrame) -> DataFrame:
    return curves.select("method", "threshold", "fdr", "n_matches").orderBy("method", "threshold")


def robustness_rows(results: DataFrame) -> DataFrame:
    return results.groupBy("method", "ppm").agg(F.avg("topk_accuracy").alias("mean"),
                                                F.stddev_samp("topk_accuracy").alias("sd"), F.count("*").alias("n"))
