"""Study-design helpers: valid spectra, unique names, controlled subsets, mixtures by RI."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.peaks import total
from .metrics import strict_prefix
from .sampling import sample_per_group


def valid_spectra(df: DataFrame, peaks: str = "frag", min_peaks: int = 2) -> DataFrame:
    return df.filter((F.size(peaks) >= min_peaks) & (total(F.col(peaks)) > 0))


def identified(df: DataFrame, key: str = "inchikey") -> DataFrame:
    """Rows with a retention index and a key of at least 14 characters."""
    return df.filter(F.col("ri").isNotNull() & (F.length(key) >= 14))


def unique_names(df: DataFrame, name: str = "name", number: str = "db_number") -> DataFrame:
    """Append the record number where a name repeats."""
    many = df.groupBy(name).agg((F.count("*") > 1).alias("_dup"))
    return df.join(many, name).withColumn(name, F.when(F.col("_dup"), F.concat_ws(
        "_DB", F.col(name), F.col(number).cast("string"))).otherwise(F.col(name))).drop("_dup")


def controlled_subset(df: DataFrame, mapping: DataFrame, cap: int, seed: int = 1, key: str = "inchikey") -> DataFrame:
    """Mapped spectra, at most ``cap`` per key prefix in seeded order."""
    x = df.join(mapping, "id").withColumn("_p", strict_prefix(F.col(key))).filter(F.col("_p").isNotNull())
    return sample_per_group(x, "_p", cap, seed).drop("_p")


def ri_interferents(signal: DataFrame, pool: DataFrame, window: float, components: int = 1, seed: int = 1,
                    key: str = "inchikey") -> DataFrame:
    """Interferents inside the RI window, other compounds first, in seeded order.

    RI bands make it an equi-join; ``WindowGroupLimit`` keeps only ``components`` rows
    per signal and task.  Signals left short are filled by the caller (choose_partners).
    """
    band = F.floor(F.col("ri") / float(window))
    s = signal.filter(F.col("ri").isNotNull()).select(
        F.col("pos"), F.col("ri").alias("_ri"), strict_prefix(F.col(key)).alias("_k"), F.explode(F.array(band - 1, band, band + 1)).alias("_b"))
    n = pool.filter(F.col("ri").isNotNull()).select(
        F.col("pos").alias("noise_pos"), F.col("id").alias("noise_id"), F.col("ri").alias("_nri"), strict_prefix(F.col(key)).alias("_nk"), band.alias("_b"))
    x = s.join(n, "_b").filter((F.col("pos") != F.col("noise_pos")) & (F.abs(F.col("_ri") - F.col("_nri")) <= window))
    same = F.coalesce(F.col("_k") == F.col("_nk"), F.lit(False)).cast("int")
    w = Window.partitionBy("pos").orderBy(same, F.xxhash64(F.lit(seed), "pos", "noise_pos"), "noise_pos")
    return x.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= components).select("pos", "slot", "noise_pos", "noise_id")
