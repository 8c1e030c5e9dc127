"""Shared Spark types."""

from pyspark.sql import types as T

PEAK = T.StructType([
    T.StructField("mz", T.DoubleType(), False),
    T.StructField("intensity", T.DoubleType(), False),
])
PEAKS = T.ArrayType(PEAK, False)
PEAKS_DDL = "array<struct<mz:double,intensity:double>>"

# spectrum channels produced by the builder
CHANNELS = ["frag", "loss", "loss_anchor", "loss_pair"]
TYPICAL_CHANNELS = ["loss_typ", "loss_anchor_typ", "loss_pair_typ"]

MSP_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("name", "cas", "inchikey", "inchi", "smiles", "formula")]
    + [T.StructField(c, T.DoubleType()) for c in ("mw", "ri", "rt")]
    + [T.StructField("num_peaks", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in (
        "spectrum", "synonyms", "comment", "instrument", "ion_mode", "precursor_type",
        "collision_energy", "source", "splash", "other_metadata")]
)
