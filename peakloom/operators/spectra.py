"""From serialized spectra to the scored channels, as one narrow projection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import peaks as P
from ..functions.derived import difference_channels, to_arrow
from ..functions.ragged import Batch
from ..params import deriv_losses
from ..schema import CHANNELS, PEAKS


#: Spectra whose differences are held at once: up to 780 a spectrum, about 100 MB of working arrays.
SLICE = 512


def spread(df: DataFrame, *keys) -> DataFrame:
    """Give CPU-heavy work on few input splits a task per core.

    Large inputs already have more splits than that and pass through untouched.
    """
    spark = df.sparkSession
    want = max(spark.sparkContext.defaultParallelism, 1)
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys)


def with_position(df: DataFrame, order_by=("id",)) -> DataFrame:
    """Add ``pos``, a unique ordinal that follows ``order_by``.

    Sorting range-partitions the rows; the ordinal packs the partition number above
    the row number, so no single task sees every row.
    """
    return df.orderBy(*order_by).withColumn("pos", F.monotonically_increasing_id())


def _row_losses(p, deriv_type):
    """Loss table of one row: base losses plus the derivatization losses in force."""
    base = P.loss_table(p.base_losses)
    if p.deriv_mode == "manual":
        return P.loss_table(p.base_losses + deriv_losses(p.deriv_allowed))
    if p.deriv_mode == "auto":
        n = len(p.base_losses)
        out = base
        for kind in ("TMS", "TBDMS"):
            if p.deriv_allowed in (kind, "BOTH"):
                extra = P.loss_table(deriv_losses(kind))
                extra = F.transform(extra, lambda l: l.withField("idx", l["idx"] + n))
                out = F.when(deriv_type == kind, F.concat(base, extra)).otherwise(out)
        return out
    return base


def build_channels(df: DataFrame, p, peaks: str = "peaks", reference_mz=None) -> DataFrame:
    """Add every spectrum channel and its diagnostics to ``df``.

    Input needs an array column of raw peaks; all other columns pass through.
    ``reference_mz`` (number or Column) overrides the estimated reference mass.
    """
    raw = F.col(peaks)
    out = df
    if p.deriv_mode == "auto":
        plain = P.prep_peaks(raw, p.with_(use_sqrt=False))
        out = out.withColumn("_deriv", P.detect_derivatization(plain, p))
        deriv_type = F.col("_deriv.type")
        extra = {n: F.col(f"_deriv.{n}") for n in
                 ("score_tms", "score_tbdms", "i73", "i147", "i115", "i57")}
    else:
        deriv_type = F.lit(p.deriv_allowed if p.deriv_mode == "manual" else "none")
        score = F.lit(None).cast("double") if p.deriv_mode == "manual" else F.lit(0.0)
        none = F.lit(None).cast("double")
        extra = dict(score_tms=score, score_tbdms=score, i73=none, i147=none, i115=none, i57=none)
    out = out.withColumn("derivatization_type", deriv_type).withColumns(
        {("deriv_" + k): v for k, v in extra.items()}).drop("_deriv")

    frag = P.prep_peaks(raw, p)
    if p.deriv_mode != "off" and p.derivatization_frag_weight < 1:
        for kind, ions in (("TMS", C.TMS_IONS), ("TBDMS", C.TBDMS_IONS)):
            frag = F.when(F.col("derivatization_type").isin(kind, "BOTH"), P.downweight_normalized(
                frag, ions, p.diagnostic_ppm, p.derivatization_frag_weight)).otherwise(frag)
    out = out.withColumn("frag", frag)

    fr = F.col("frag")
    out = out.withColumn("_losses", _row_losses(p, F.col("derivatization_type")))
    out = out.withColumn("_found", F.coalesce(
        P.detected_losses(fr, F.col("_losses"), p.tol_ppm),
        F.array().cast("array<struct<formula:string,cls:string,exact_loss:double,from_peak:double,"
                       "to_mref:double,intensity:double,ppm_error:double>>")))
    found = F.col("_found")
    mref = P.reference_mass(fr, found)
    if reference_mz is not None:
        given = reference_mz if not isinstance(reference_mz, (int, float)) else F.lit(float(reference_mz))
        mref = F.when(F.size(fr) > 0, given)
    names = F.array_distinct(F.transform(found, lambda d: d["formula"]))
    out = out.withColumns({
        "estimated_Mref": mref,
        "mref_confidence": F.when(F.size(fr) > 0, P.reference_confidence(fr, found, p)),
        "detected_neutral_losses": F.when(F.size(found) == 0, "none").otherwise(F.array_join(names, ";")),
        "inferred_functional_groups": F.array_join(
            F.array_distinct(F.transform(found, lambda d: d["cls"])), ";"),
    })

    # the loss tables would travel through the Python worker with every row
    out = with_differences(out.drop("_losses", "_found"), p)
    if p.use_typical_loss:
        out = out.withColumn("_losses", _row_losses(p, F.col("derivatization_type")))

        def typ(ch):
            return P.project_typical(F.col(ch), F.col("_losses"), p.typical_ppm,
                                     p.derivatization_typical_weight)
        cols = {"loss_typ": typ("loss")}
        if p.use_split_loss:
            cols.update(loss_anchor_typ=typ("loss_anchor"), loss_pair_typ=typ("loss_pair"))
        out = out.withColumns(cols)
    return out.drop("_losses")


def with_differences(df: DataFrame, p) -> DataFrame:
    """Add the pooled, anchored and pairwise difference spectra.

    Each spectrum makes up to 780 differences that must be binned within its row;
    one vectorised pass over Arrow batches does that without a shuffle, ``SLICE`` spectra at once.
    """
    masses = []
    if p.deriv_mode != "off" and p.derivatization_raw_loss_weight < 1:
        masses = [(row[1], kind) for kind in ("TMS", "TBDMS") for row in deriv_losses(kind)]
    schema = T.StructType(df.schema.fields + [T.StructField(c, PEAKS) for c in CHANNELS[1:]])

    def run(batches):
        for batch in (b.slice(s, SLICE) for b in batches for s in range(0, b.num_rows, SLICE)):
            t = pa.Table.from_batches([batch])
            frag = Batch.from_arrow(t.column("frag"))
            mref = t.column("estimated_Mref").to_numpy().astype(float)
            conf = t.column("mref_confidence").to_numpy().astype(float)
            kinds = np.array(t.column("derivatization_type").to_pylist(), dtype=object)
            down = [(m, (kinds == k) | (kinds == "BOTH")) for m, k in masses]
            for name, ch in zip(CHANNELS[1:], difference_channels(frag, mref, conf, down, p)):
                t = t.append_column(name, to_arrow(ch))
            yield from t.combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def with_class(df: DataFrame, p, peaks: str = "frag") -> DataFrame:
    """Class label; an unclassified spectrum falls back to its neutral-loss groups."""
    label = P.detect_class(F.col(peaks), p.class_detection_ppm, rules=p.classify_rules)
    weak = F.col("_label").isin("unclassified", "unknown")
    groups = F.col("inferred_functional_groups")
    use_nl = weak & (F.length(groups) > 0)
    return (df.withColumn("_label", label)
            .withColumn("compound_class", F.when(use_nl, F.concat(F.lit("NL:"), groups))
                        .otherwise(F.col("_label")))
            .withColumn("compound_class_source", F.when(use_nl, "neutral_loss").otherwise("fragment"))
            .drop("_label"))


def build_spectra(df_spec: DataFrame, p, text: str = "ei") -> DataFrame:
    """Parse ``text`` and add all channels and class labels."""
    parsed = df_spec.withColumn("peaks", P.parse_peaks(F.col(text)))
    return with_class(build_channels(parsed, p), p).drop("peaks")


def class_summary(spectra: DataFrame) -> DataFrame:
    return (spectra.groupBy("compound_class").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "compound_class"))


def class_summary_simple(spectra: DataFrame) -> DataFrame:
    """Counts per single class name of the ';'-joined labels."""
    return (spectra.select(F.explode(F.split("compound_class", ";")).alias("class"))
            .groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class"))


def functional_group_counts(spectra: DataFrame) -> DataFrame:
    return (spectra.select(F.explode(F.split("inferred_functional_groups", ";")).alias("group"))
            .filter(F.length("group") > 0)
            .groupBy("group").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group"))


def mz_frequency(spectra: DataFrame, peaks: str = "frag", id_col: str = "id",
                 bin_width: float = 1.0) -> DataFrame:
    """Share of all spectra (empty ones included) with a peak in each m/z bin.

    Bins are de-duplicated inside each row, so one partial-aggregated shuffle of
    at most one row per bin and task is all that moves.
    """
    if not bin_width > 0:
        raise ValueError("bin_width must be > 0")
    bins = F.array_distinct(F.transform(F.col(peaks), lambda x: P.mz_bin(x["mz"], bin_width)))
    n = spectra.agg(F.count("*")).scalar()
    return (spectra.select(F.explode(bins).alias("mz_bin"))
            .groupBy("mz_bin").agg(F.count("*").alias("n_spectra"))
            .withColumn("frequency", F.col("n_spectra") / n))


def weight_spectra(spectra: DataFrame, frequency: DataFrame | None = None, intensity_power: float = 0.5,
                   freq_power: float = 0.5, bin_width: float = 1.0) -> DataFrame:
    """Re-weight the fragment channel by intensity and bin frequency, losses by
    intensity only.  Bins are bounded by the m/z range, so the frequency table is a
    one-row map attached to every spectrum by a scalar subquery."""
    if intensity_power <= 0 or freq_power <= 0:
        raise ValueError("powers must be > 0")
    table = None
    if frequency is not None:
        table = frequency.agg(F.map_from_entries(F.collect_list(
            F.struct("mz_bin", "frequency")))).scalar()
        spectra = spectra.withColumn("_freq", table)
        table = F.col("_freq")
    cols = {"frag": P.weight_peaks(F.col("frag"), table, intensity_power, freq_power, bin_width)}
    for ch in ("loss", "loss_anchor", "loss_pair"):
        if ch in spectra.columns:
            cols[ch] = P.weight_peaks(F.col(ch), None, intensity_power)
    return spectra.withColumns(cols).drop("_freq")


def loss_peaks_long(spectra: DataFrame, channel: str = "loss", id_col: str = "id") -> DataFrame:
    return spectra.select(id_col, F.explode(channel).alias("x")).select(
        id_col, F.col("x.mz").alias("mz"), F.col("x.intensity").alias("intensity"))


def first_per_id(df: DataFrame, key, order_by="pos") -> DataFrame:
    """Keep the first row per key in input order."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order_by)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
