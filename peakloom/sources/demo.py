"""Synthetic MS-DIAL-like feature table; every value is a pure function of row and seed."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.sampling import uniform
from .msdial import FeatureTable, as_feature_table


def generate_demo_msdial(spark: SparkSession, n_known: int = 5, n_unknown: int = 5, n_samples: int = 6,
                         n_blanks: int = 1, n_standards: int = 1, seed: int = 1) -> FeatureTable:
    if n_known < 1 or n_unknown < 0 or n_samples < 1:
        raise ValueError("n_known and n_samples must be >= 1, n_unknown >= 0")
    row = F.col("pos")

    def draw(name, lo, hi, *more):
        return lo + uniform(seed, F.lit(name), row, *more) * (hi - lo)

    known = row <= n_known
    n_peaks = (15 + F.floor(uniform(seed, F.lit("n"), row) * 16)).cast("int")
    peaks = F.array_sort(F.transform(F.sequence(F.lit(1), n_peaks), lambda i: F.struct(
        F.round(draw("mz", 35.0, 300.0, i), 5).alias("mz"), F.round(draw("int", 100.0, 50000.0, i)).cast("long").alias("it"))))
    fixed = {
        "Alignment ID": row.cast("string"), "Average Rt(min)": F.round(draw("rt", 2, 20), 3),
        "Average RI": F.round(draw("ri", 400, 1200), 2), "Quant mass": F.round(draw("qm", 40, 300), 5),
        "Metabolite name": F.when(known, F.concat(F.lit("Compound_"), row.cast("string"))).otherwise("Unknown"),
        "Fill %": F.round(draw("fill", 0.7, 1.0), 3), "INCHIKEY": F.when(known, F.concat(F.lit("KEY"), row.cast("string"))),
        "Annotation tag (VS1.0)": F.when(known, "1").otherwise("4"), "RT/RI matched": F.lit("False"),
        "EI-MS matched": F.lit("False"), "Manually modified for quantification": F.lit("FALSE"),
        "Manually modified for annotation": F.lit("FALSE"), "S/N average": F.round(draw("sn", 50, 500), 2),
        "Spectrum reference file name": F.lit("demo"),
        "EI spectrum": F.array_join(F.transform(peaks, lambda x: F.format_string("%.5f:%d", x["mz"], x["it"])), " ")}
    cols = [fixed.get(c, F.lit(None).cast("string")).alias(c) for c in C.FEATURE_META_COLUMNS]
    base = draw("base", 0.2, 1.2)
    quant = {}
    for prefix, n, lo, hi in (("STD_", n_standards, 0.8, 1.2), ("BLK_", n_blanks, 0.0, 0.15), ("S", n_samples, 0.6, 1.6)):
        for i in range(1, n + 1):
            quant[f"{prefix}{i:02d}"] = base * draw(f"{prefix}{i}", lo, hi)
    df = spark.range(1, n_known + n_unknown + 1).select(F.col("id").alias("pos"), "*").drop("id")
    df = df.select("pos", *cols, *[e.alias(n) for n, e in quant.items()])
    s = F.array(*[F.col(f"S{i:02d}") for i in range(1, n_samples + 1)])
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n_samples
    var = F.aggregate(F.transform(s, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / max(1, n_samples - 1)
    return as_feature_table(df.withColumns({"Average": F.round(mean, 4), "Stdev": F.round(F.sqrt(var), 4)}))
