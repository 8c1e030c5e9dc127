"""Feature-table filters: known/unknown split, blanks, detection rate, de-duplication."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import msdial as M
from .spectra import first_per_id

TAG = "Annotation tag (VS1.0)"
NAME = "Metabolite name"


def compound_id():
    """Unknowns (tag 4) are told apart by their alignment id."""
    return F.when(F.col(f"`{TAG}`") == "4", F.concat_ws("_", F.col(f"`{NAME}`"), F.col("`Alignment ID`"))
                  ).otherwise(F.col(f"`{NAME}`"))


def _array(cols):
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols])


def row_mean(cols):
    """Mean over non-null values; NULL when there are none."""
    vals = F.filter(_array(cols), lambda x: x.isNotNull())
    return F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size(vals))


def dedupe_known(df: DataFrame, name: str = NAME, key: str = "INCHIKEY", order="mean") -> DataFrame:
    """First row per name by descending mean, then first per key among rows with one.

    Adds ``_part`` (0 keyed, 1 without key), which is their output order.
    """
    by = [F.desc(order), F.asc("pos")]
    once = first_per_id(df, name, by)
    has_key = F.length(F.coalesce(F.col(f"`{key}`"), F.lit(""))) > 0
    # rows without a key are their own group, so no single group collects them
    group = F.when(has_key, F.concat(F.lit("k"), F.col(f"`{key}`"))).otherwise(
        F.concat(F.lit("p"), F.col("pos").cast("string")))
    out = first_per_id(once.withColumn("_group", group), "_group", by)
    return out.withColumn("_part", F.when(has_key, 0).otherwise(1)).drop("_group")


def filter_known(df: DataFrame, cols, deduplicate: bool = True) -> DataFrame:
    out = df.withColumn("mean", row_mean(cols)).filter("mean > 0")
    return dedupe_known(out) if deduplicate else out.withColumn("_part", F.lit(0))


def filter_unknown(df: DataFrame, cols, deduplicate: bool = False) -> DataFrame:
    out = df.withColumn("mean", row_mean(cols)).filter("mean > 0")
    if deduplicate:
        out = first_per_id(out, [NAME, "Alignment ID"], [F.desc("mean"), F.asc("pos")])
    return out.withColumn("_part", F.lit(2))


def reference_values(df: DataFrame, ref, cols):
    """Values of the reference row (row number, alignment id or name) for ``cols``."""
    order = ["_part", F.desc("mean"), "pos"]
    if isinstance(ref, (int, float)) and not isinstance(ref, bool):
        rows = df.orderBy(*order).limit(int(ref)).collect() if ref >= 1 else []
        if len(rows) < int(ref):
            raise ValueError("normalize_ref row index is out of range")
        row = rows[-1]
    else:
        text = str(ref)
        hits = []
        for col in ("Alignment ID", NAME):
            hits = df.filter(F.col(f"`{col}`").cast("string") == text).orderBy(*order).limit(2).collect()
            if hits:
                break
        if not hits:
            raise ValueError("normalize_ref not found in Alignment ID or Metabolite name")
        if len(hits) > 1:
            warnings.warn("normalize_ref matched multiple rows; using the first match")
        row = hits[0]
    return {c: row[c] for c in cols}


def divide_by_reference(df: DataFrame, values: dict) -> DataFrame:
    usable = {c: float(v) for c, v in values.items() if v is not None and v == v and v != 0
              and abs(float(v)) != float("inf")}
    if not usable:
        raise ValueError("normalize_ref has only missing or zero values in the selected columns")
    if len(usable) < len(values):
        warnings.warn("normalize_ref has missing or zero values in some columns; those are skipped")
    return df.withColumns({c: F.col(f"`{c}`") / v for c, v in usable.items()})


def zero_below_blank(df: DataFrame, quant_cols, blank_cols, factor: float) -> DataFrame:
    """Keep values strictly above blank mean * factor, zero the rest, leave NULL alone."""
    blank = F.coalesce(row_mean(blank_cols), F.lit(0.0)) if blank_cols else F.lit(0.0)
    df = df.withColumn("blank_mean", blank)
    floor = F.col("blank_mean") * factor
    return df.withColumns({c: F.when(F.col(f"`{c}`") > floor, F.col(f"`{c}`"))
                           .when(F.col(f"`{c}`") <= floor, 0.0)
                           .otherwise(F.col(f"`{c}`")) for c in quant_cols})


def detected_enough(df: DataFrame, cols, ratio: float) -> DataFrame:
    """Strictly more than ``ratio`` of the columns positive; any NULL drops the row."""
    n = F.aggregate(F.transform(_array(cols), lambda x: (x > 0).cast("int")), F.lit(0), lambda a, x: a + x)
    return df.withColumn("nonzero", n).filter(F.col("nonzero") > len(cols) * float(ratio))


@dataclass
class QuantResult:
    normalized: DataFrame
    cleaned: DataFrame
    final: DataFrame
    sample_cols: list
    quant_cols: list
    signal_cols: list
    blank_cols: list
    qc_cols: list
    std_cols: list


def prepare_quant_data(table, params, blank_factor: float = 3, nonzero_ratio: float = 0.2,
                       cleaned_csv_path: str | None = None, export_unknown_as_id: bool = True,
                       deduplicate: bool = True) -> QuantResult:
    t = M.as_feature_table(table)
    df = t.data
    sample, blank = M.get_sample_cols(t), M.get_blank_cols(t)
    qc, std, quant = M.get_qc_cols(t), M.get_std_cols(t), M.get_quant_cols(t)
    if not sample:
        raise ValueError("no sample columns detected")
    signal = M.get_signal_cols(t) or sample
    tag = F.col(f"`{TAG}`").cast("string")
    df = df.withColumn(TAG, tag).withColumns({c: F.col(f"`{c}`").try_cast("double") for c in quant})
    known = filter_known(df.filter(tag != "4"), signal, deduplicate).withColumn("known", F.lit("T"))
    unknown = filter_unknown(df.filter(tag == "4"), signal).withColumn("known", F.lit("F"))
    both = known.unionByName(unknown).withColumn("compound_id", compound_id())

    cols = list(quant)
    if params.normalize_cols is not None:
        missing = [c for c in params.normalize_cols if c not in quant]
        if missing:
            raise ValueError(f"normalize_cols not found: {', '.join(missing)}")
        cols = list(params.normalize_cols)
    if params.normalize_ref is not None:
        both = divide_by_reference(both, reference_values(both, params.normalize_ref, cols))

    kept = zero_below_blank(both, quant, blank, blank_factor)
    kept = kept.withColumn("mean", row_mean(signal)).filter("mean > 0")
    kept = kept.drop(*blank, *std, "RT similarity")
    cleaned = detected_enough(kept, signal, nonzero_ratio)
    final = cleaned.drop(TAG, "Total score", "Average Rt(min)", "INCHIKEY", "nonzero")
    if cleaned_csv_path:
        out = cleaned
        if export_unknown_as_id:
            out = out.withColumn(NAME, F.when(F.col(f"`{TAG}`") == "4", F.col("compound_id"))
                                 .otherwise(F.col(f"`{NAME}`")))
        out.drop("_part", "pos").write.mode("overwrite").option("header", True).csv(cleaned_csv_path)
    return QuantResult(both, cleaned, final, sample, quant, signal, blank, qc, std)


def build_df_spec(table, final: DataFrame) -> DataFrame:
    """id, pos, known, ri, ei of the features that survived, first row per id."""
    df = M.as_feature_table(table).data.withColumn(TAG, F.col(f"`{TAG}`").cast("string"))
    spec = df.withColumn("id", compound_id()).join(
        final.select(F.col("compound_id").alias("id")), "id", "left_semi")
    return first_per_id(spec, "id").select(
        "id", "pos", F.when(F.col(f"`{TAG}`") == "4", "F").otherwise("T").alias("known"),
        F.col("`Average RI`").cast("double").alias("ri"),
        F.col("`EI spectrum`").alias("ei"))
