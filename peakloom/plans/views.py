"""Spectra derived from the given tables.

Each view is a plain DataFrame over whole tables:

* grid spectra    - one per embedding row: component i is the peak m/z 50 + 5*i with
                    intensity |v|; label = compound, 14-character key prefix from it
* order spectra   - one per order: a peak per line item on a part-number m/z axis, with
                    price as precursor mass, order day as retention time, and so on
* feature table   - one row per part, one column per (return flag, line status)
* scored events   - event values as scores, event types as labels
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import peaks as P
from ..operators.spectra import build_channels, spread
from ..params import Params


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_raw(spark, sf_dir) -> DataFrame:
    """id, pos, label, ri, inchikey, peaks (raw intensities |v|)."""
    e = table(spark, sf_dir, "embeddings")
    peaks = F.transform("embedding", lambda v, i: P.peak(
        (50 + 5 * i).cast("double"), F.abs(v.cast("double"))))
    prefix = F.concat(F.lit("COMPOUND-"), F.lpad(F.col("label").cast("string"), 5, "0"))
    return e.select(
        F.col("vec_id").cast("string").alias("id"), F.col("vec_id").cast("long").alias("pos"),
        F.col("label"), prefix.alias("prefix"),
        F.concat(prefix, F.lit("-"), (F.col("vec_id") % 7).cast("string")).alias("inchikey"),
        (600.0 + F.pmod(F.col("vec_id") * 37, F.lit(1000))).alias("ri"), peaks.alias("peaks"))


def grid_prepared(spark, sf_dir, p: Params | None = None) -> DataFrame:
    """Grid spectra with the fragment channel only."""
    p = p or Params()
    return grid_raw(spark, sf_dir).withColumn("frag", P.prep_peaks(F.col("peaks"), p)).drop("peaks")


def grid_channels(spark, sf_dir, p: Params | None = None, reference_mz=None) -> DataFrame:
    """Grid spectra with all channels."""
    raw = spread(grid_raw(spark, sf_dir), "id")
    return build_channels(raw, p or Params(), reference_mz=reference_mz).drop("peaks")


def order_raw(spark, sf_dir) -> DataFrame:
    """id, pos, peaks and LC metadata, one row per order that has line items."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (35 + F.col("l_partkey") % 600 + F.col("l_linenumber") / 1000.0).alias("mz"),
        F.col("l_quantity").alias("intensity"))
    grouped = li.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), F.col("o_totalprice").alias("precursor_mz"),
        F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double").alias("rt"),
        F.col("o_orderstatus").alias("ion_mode"), F.col("o_orderpriority").alias("adduct"))
    return grouped.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").cast("long").alias("pos"),
        "precursor_mz", "rt", "ion_mode", "adduct",
        F.pmod(F.col("o_orderkey"), F.lit(40)).cast("double").alias("collision_energy"), "peaks")


def scored_events(spark, sf_dir) -> DataFrame:
    """event_id, user_id, score in cents, positive flag."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("score"),
        (F.col("event_type") == "purchase").alias("positive"))
