"""Derivatization labels, rule predictions and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.peaks import derivatization_call, is_finite

# --- fixed values: label spellings ---
NONE_LABELS = ["NA", "NONE", "NO"]
TMS_LABELS = ["TMS", "TRIMETHYLSILYL", "TRIMETHYLSILYLATION"]
TBDMS_LABELS = ["TBDMS", "T-BDMS", "MTBSTFA"]
LEVELS = ["none", "TMS", "TBDMS"]
MIN_INT_GRID = [round(0.01 + 0.005 * i, 3) for i in range(9)]
STRONG_INT_GRID = [round(0.05 + 0.01 * i, 2) for i in range(11)]


def normalize_label(col):
    text = F.upper(F.coalesce(F.nullif(col, F.lit("")), F.lit("none")))
    return (F.when(text.isin(NONE_LABELS), "none").when(text.isin(TMS_LABELS), "TMS")
            .when(text.isin(TBDMS_LABELS), "TBDMS").otherwise(text))


def predict(i73, i147, i115, i57, min_int=0.02, strong_int=0.08, allowed: str = "BOTH"):
    """Rule label from the four diagnostic intensities; bad values count as 0."""
    def ok(x, on):
        return F.when(is_finite(x) & (x >= 0), x).otherwise(0.0) if on else F.lit(0.0)

    tms, tbd = allowed in ("TMS", "BOTH"), allowed in ("TBDMS", "BOTH")
    return derivatization_call(ok(i73, tms), ok(i147, tms), ok(i115, tbd), ok(i57, tbd), min_int, strong_int)["type"]


def at_level(col):
    x = normalize_label(col)
    return F.when(x.isin(LEVELS), x).otherwise("none")


def evaluate(df: DataFrame, truth: str, predicted) -> DataFrame:
    """Accuracy and recall per level in one aggregation."""
    return _metrics(df, at_level(F.col(truth)), at_level(predicted))


def _metrics(df: DataFrame, t, y, *by) -> DataFrame:
    hit = t == y
    aggs = [(F.count_if(hit) / F.greatest(F.count("*"), F.lit(1))).alias("accuracy")]
    aggs += [F.try_divide(F.count_if(hit & (t == lv)).cast("double"), F.count_if(t == lv)).alias(f"recall_{lv}")
             for lv in LEVELS]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def sweep_rule(df: DataFrame, truth: str, min_grid=MIN_INT_GRID, strong_grid=STRONG_INT_GRID,
               allowed: str = "BOTH", ions=("deriv_i73", "deriv_i147", "deriv_i115", "deriv_i57")) -> DataFrame:
    """Metrics for every (min_int, strong_int).

    Each row expands to the fixed grid of settings and collapses again in the map-side
    combine, so the shuffle carries one row per setting and task.
    """
    grid = F.array(*[F.struct(F.lit(a).alias("min_int"), F.lit(b).alias("strong_int"))
                     for a in min_grid for b in strong_grid])
    x = df.select(at_level(F.col(truth)).alias("t"), *[F.col(c) for c in ions]).withColumn("g", F.explode(grid))

    def ok(c):
        return F.when(is_finite(F.col(c)) & (F.col(c) >= 0), F.col(c)).otherwise(0.0)

    on = [allowed in ("TMS", "BOTH")] * 2 + [allowed in ("TBDMS", "BOTH")] * 2
    v = [ok(c) if use else F.lit(0.0) for c, use in zip(ions, on)]
    low, strong = F.col("g.min_int"), F.col("g.strong_int")
    tms = (v[0] >= low) & ((v[1] >= low / 2) | (v[0] >= strong))
    tbd = (v[2] >= low) & ((v[3] >= low / 2) | (v[2] >= strong))
    y = F.when(tms & (~tbd | (v[0] + 0.5 * v[1] >= v[2] + 0.2 * v[3])), "TMS").when(tbd, "TBDMS").otherwise("none")
    x = x.select("t", F.col("g.min_int").alias("min_int"), F.col("g.strong_int").alias("strong_int"), y.alias("y"))
    return _metrics(x, F.col("t"), F.col("y"), "min_int", "strong_int")


def run_evaluation(df: DataFrame, truth: str, out_dir: str | None = None, **kw) -> dict:
    """Confusion table, metrics and rule sweep; CSV output when ``out_dir`` is given."""
    from .metrics import confusion
    pred = predict(*[F.col(c) for c in ("deriv_i73", "deriv_i147", "deriv_i115", "deriv_i57")])
    x = df.withColumns({"_t": at_level(F.col(truth)), "_y": at_level(pred)})
    out = {"confusion": confusion(x, "_t", "_y", LEVELS), "metrics": evaluate(df, truth, pred),
           "sweep": sweep_rule(df, truth, **kw)}
    if out_dir:
        for name, frame in out.items():
            frame.write.mode("overwrite").option("header", True).csv(f"{out_dir}/{name}")
    return out
