"""Named queries over the given tables, one per operator family."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import peaks as P
from ..operators import benchmark as B
from ..operators import bin_index as BI
from ..operators import clustering as CL
from ..operators import deriv as DV
from ..operators import explain as X
from ..operators import layout as LO
from ..operators import lc as LC
from ..operators import metrics as M
from ..operators import noise as N
from ..operators import quant as Q
from ..operators import sampling as SA
from ..operators import search as S
from ..operators import similarity as SI
from ..operators import sparse as SP
from ..operators import spectra as SB
from ..operators import stats as ST
from ..operators import ties as TI
from ..operators.blocks import Scorer, nearest
from ..params import LCSearchPlan, Params, lc_default_params
from ..sources import msdial as MD
from ..sources import msp as MSP
from . import views as V

QUERIES: dict = {}


def query(fn):
    """Register ``fn(spark, sf_dir)`` under its own name."""
    def run(spark, sf_dir):
        return tidy(fn(spark, sf_dir))
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def tidy(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and doubles at 6 decimals, so engines compare exactly."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + 0.0
        cols.append(c.alias(f.name))
    return df.select(*cols)


def grid(spark, sf_dir, p=None):
    return V.grid_prepared(spark, sf_dir, p)


def built(spark, sf_dir, p=None):
    """Grid spectra with all channels, kept for the two sides of a self-search."""
    return V.grid_channels(spark, sf_dir, p).persist()


def lid(df):
    """Ids of grid spectra are numbers; show them as BIGINT."""
    return df.withColumns({c: F.col(c).cast("long") for c in ("id", "query_id", "library_id", "medoid_id") if c in df.columns})


def long_peaks(df, channel):
    return df.select(F.col("pos").alias("id"), F.explode(channel).alias("x")).select(
        "id", F.col("x.mz").alias("mz"), F.col("x.intensity").alias("intensity"))


# --- per-spectrum operators ----------------------------------------------------

@query
def parse_peaks(spark, sf):
    """Serialized spectra of all orders, parsed back to peaks."""
    o = V.order_raw(spark, sf).withColumn("text", P.format_peaks(F.col("peaks")))
    return long_peaks(o.withColumn("p", P.parse_peaks(F.col("text"))), "p").groupBy("id").agg(
        F.count("*").alias("n"), F.sum("intensity").alias("total"), F.min("mz").alias("low"), F.max("mz").alias("high"))


@query
def tic_normalize(spark, sf):
    o = V.order_raw(spark, sf).withColumn("p", P.tic_normalize(F.col("peaks")))
    return long_peaks(o, "p")


@query
def prep_peaks(spark, sf):
    return long_peaks(grid(spark, sf), "frag")


@query
def centroid_orders(spark, sf):
    """Anchor-greedy centroiding of order spectra (line numbers of one part lie within 20 ppm and merge)."""
    p = Params(centroid_ppm=20.0, noise_thr=0.0)
    o = V.order_raw(spark, sf).withColumn("frag", P.prep_peaks(F.col("peaks"), p))
    return o.select(F.col("pos").alias("id"), F.size("peaks").alias("n_raw"), F.size("frag").alias("n"),
                    P.total(F.col("frag")).alias("total"))


@query
def intensity_at_mass(spark, sf):
    return grid(spark, sf).select(F.col("pos").alias("id"), P.intensity_at(F.col("frag"), 100.001, 20.0).alias("i100"),
                                  P.intensity_at(F.col("frag"), 101.0, 20.0).alias("i101"))


@query
def mz_frequency(spark, sf):
    return SB.mz_frequency(grid(spark, sf)).select("mz_bin", "n_spectra", "frequency")


@query
def frequency_weights(spark, sf):
    g = grid(spark, sf)
    return long_peaks(SB.weight_spectra(g, SB.mz_frequency(g)), "frag")


@query
def reference_mass(spark, sf):
    return built(spark, sf).select(F.col("pos").alias("id"), F.col("estimated_Mref").alias("mref"),
                                   F.col("mref_confidence").alias("confidence"))


@query
def neutral_losses(spark, sf):
    """Distinct detected loss formulas per spectrum."""
    return built(spark, sf).select(F.col("pos").alias("id"), F.explode(F.split("detected_neutral_losses", ";")).alias("formula"))


@query
def functional_groups(spark, sf):
    return SB.functional_group_counts(built(spark, sf))


@query
def derived_pooled(spark, sf):
    return long_peaks(built(spark, sf), "loss")


@query
def derived_anchored(spark, sf):
    return long_peaks(built(spark, sf), "loss_anchor")


@query
def derived_pairwise(spark, sf):
    return long_peaks(built(spark, sf), "loss_pair")


TYP = Params(use_typical_loss=True, use_extended_losses=True, loss_typical_ppm=1200.0)


@query
def typical_projection(spark, sf):
    """Derived peaks moved to the nearest known loss (wide ppm to match the 5 Da axis)."""
    x = built(spark, sf, TYP)
    return x.select(F.col("pos").alias("id"), F.explode("loss_typ").alias("x")).select("id", "x.formula", F.col("x.intensity").alias("intensity"))


ION_AXIS = [39.0235, 41.0391, 43.0184, 43.0548, 44.0262, 44.0626, 45.0340, 55.0548, 57.0704, 58.0419, 61.0290, 68.0262,
            69.0704, 71.0861, 73.0474, 77.0391, 78.0470, 83.0861, 85.1017, 91.0548, 93.0704, 99.1174, 115.0943,
            136.1252, 147.0654, 161.1330, 204.1878]


def ion_spectra(spark, sf):
    """Order spectra on the diagnostic-ion axis: part number picks the ion."""
    li = V.table(spark, sf, "lineitem")
    axis = F.array(*[F.lit(m) for m in ION_AXIS])
    mz = F.get(axis, F.pmod(F.col("l_partkey"), F.lit(len(ION_AXIS))).cast("int"))
    one = li.groupBy("l_orderkey", mz.alias("mz")).agg(F.sum("l_quantity").alias("intensity"))
    return one.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks")).select(
        F.col("l_orderkey").cast("string").alias("id"), F.col("l_orderkey").alias("pos"), "peaks").withColumn(
        "frag", P.prep_peaks(F.col("peaks"), Params()))


@query
def compound_class(spark, sf):
    """Class label of every order spectrum on the ion axis."""
    return ion_spectra(spark, sf).select(F.col("pos").alias("id"), P.detect_class(F.col("frag")).alias("compound_class"))


@query
def class_counts(spark, sf):
    x = ion_spectra(spark, sf).withColumn("compound_class", P.detect_class(F.col("frag")))
    return SB.class_summary_simple(x)


@query
def derivatization_detect(spark, sf):
    d = P.detect_derivatization(F.col("frag"), Params(derivatization_type="BOTH"))
    return ion_spectra(spark, sf).withColumn("d", d).select(
        F.col("pos").alias("id"), F.col("d.type").alias("type"), F.col("d.score_tms").alias("score_tms"),
        F.col("d.score_tbdms").alias("score_tbdms"))


def ion_truth(spark, sf):
    d = P.detect_derivatization(F.col("frag"), Params(derivatization_type="BOTH"))
    x = ion_spectra(spark, sf).withColumn("d", d)
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderstatus")
    truth = F.when(F.col("o_orderstatus") == "F", "tms").when(F.col("o_orderstatus") == "O", "T-BDMS").otherwise("no")
    return x.join(o, "pos").select("pos", truth.alias("truth"), *[F.col(f"d.{i}").alias(f"deriv_{i}") for i in ("i73", "i147", "i115", "i57")])


@query
def derivatization_confusion(spark, sf):
    x = ion_truth(spark, sf)
    pred = DV.predict(*[F.col(f"deriv_{i}") for i in ("i73", "i147", "i115", "i57")])
    x = x.withColumns({"t": DV.at_level(F.col("truth")), "y": DV.at_level(pred)})
    return M.confusion(x, "t", "y", DV.LEVELS)


@query
def derivatization_sweep(spark, sf):
    return DV.sweep_rule(ion_truth(spark, sf), "truth")


@query
def shared_peak_flags(spark, sf):
    """Mirror-plot rows of each spectrum with its successor in id order."""
    g = grid(spark, sf)
    nxt = g.select((F.col("pos") - 1).alias("pos"), F.col("frag").alias("other"))
    pairs = g.select(F.col("pos"), "frag").join(nxt, "pos")
    return N.mirror_long(pairs, "frag", "other", 20.0).select(F.col("pos").alias("id"), "side", "mz", "intensity", "shared")


@query
def perturbed_spectra(spark, sf):
    x = N.perturb_spectra(V.grid_prepared(spark, sf), 10.0, 0.1, 0.1, seed=7)
    return x.select(F.col("pos").alias("id"), F.size("frag").alias("n"), P.total(F.col("frag")).alias("total"))


@query
def mixture_fixed_pair(spark, sf):
    """Each spectrum mixed at 20 % with its successor: TIC attribution and peaks."""
    g = grid(spark, sf)
    nxt = g.select((F.col("pos") - 1).alias("pos"), F.col("frag").alias("noise"))
    m = N.mix_columns(g.select("pos", "frag").join(nxt, "pos"), "frag", "noise", 0.2, 10.0)
    return long_peaks(m, "mixture")


@query
def mixture_seeded(spark, sf):
    m = N.mix_with_pool(grid(spark, sf).select("id", "pos", "frag"), signal_fraction=0.2, noise_components=2, seed=5)
    return m.select(F.col("pos").alias("id"), "noise_ids", "signal_tic_fraction", "n_mixture_peaks")


@query
def systematic_drift(spark, sf):
    x = N.coordinate_shift(grid(spark, sf), "systematic_drift", 10.0, theta=0.5)
    return long_peaks(x, "frag")


@query
def anchor_error(spark, sf):
    """Reference shifted by 0.01: share of mass whose anchored bins moved; pairwise kept."""
    b = built(spark, sf)
    s = N.shift_anchor(b, 0.01, Params()).select("pos", F.col("loss_anchor").alias("a2"), F.col("loss_pair").alias("p2"))
    return b.join(s, "pos").select(F.col("pos").alias("id"), (F.col("loss_pair") == F.col("p2")).alias("pairwise_same"),
                                   F.size(F.array_intersect(F.transform("loss_anchor", lambda x: x["mz"]),
                                                            F.transform("a2", lambda x: x["mz"]))).alias("anchored_shared"))


@query
def stress_siloxane(spark, sf):
    x = N.add_siloxane(V.grid_prepared(spark, sf), 0.3, seed=3)
    return x.select(F.col("pos").alias("id"), F.size("frag").alias("n"), P.total(F.col("frag")).alias("total"))


@query
def stress_background(spark, sf):
    x = N.add_background(V.grid_prepared(spark, sf), 0.3, seed=3)
    return x.select(F.col("pos").alias("id"), F.size("frag").alias("n"), P.total(F.col("frag")).alias("total"))


@query
def stress_factorial(spark, sf):
    x = N.factorial_stress(V.grid_prepared(spark, sf), 5.0, 0.1, 0.2, seed=3)
    return x.select(F.col("pos").alias("id"), F.size("frag").alias("n"))


# --- sources ---------------------------------------------------------------------

def msp_lines(spark, sf, embedded: bool = False) -> DataFrame:
    """Orders as MSP text lines (file, block, n, value).

    With ``embedded`` the newline before every fourth NAME is missing, and blank
    separators are left out.
    """
    o = V.order_raw(spark, sf).withColumn("seq", F.row_number().over(
        Window.partitionBy(F.floor(F.col("pos") / 4096)).orderBy("pos")))
    head = F.array(F.concat(F.lit("NAME: order"), F.col("id")), F.concat(F.lit("RETENTIONINDEX: "), F.col("rt").cast("int").cast("string")),
                   F.concat(F.lit("Ion_mode: "), F.col("ion_mode")), F.concat(F.lit("Origin: "), F.col("adduct")),
                   F.concat(F.lit("Num Peaks: "), F.size("peaks").cast("string")))
    body = F.transform("peaks", lambda x: F.concat(F.format_string("%.3f", x["mz"]), F.lit(" "), x["intensity"].cast("int").cast("string")))
    if embedded:
        lines = F.concat(head, body)
        # the next record's NAME is glued to this record's last peak
        x = o.withColumn("nxt", F.lead("id").over(Window.partitionBy(F.floor(F.col("pos") / 4096)).orderBy("pos")))
        glue = (F.col("seq") % 4 == 0) & F.col("nxt").isNotNull()
        x = x.withColumn("drop_name", F.coalesce(F.lag(glue).over(Window.partitionBy(F.floor(F.col("pos") / 4096)).orderBy("pos")), F.lit(False)))
        lines = F.when(F.col("drop_name"), F.slice(lines, 2, F.size(lines) - 1)).otherwise(lines)
        lines = F.when(glue, F.transform(lines, lambda v, i: F.when(i == F.size(lines) - 1, F.concat(
            v, F.lit("NAME: order"), F.col("nxt"))).otherwise(v))).otherwise(lines)
        o = x
    else:
        lines = F.concat(head, body, F.array(F.lit("")))
    # 4096 orders per file, 512 per split; rows of a split sit together in line order
    text = o.withColumn("lines", lines).select(
        F.concat(F.lit("part"), F.floor(F.col("pos") / 4096).cast("string")).alias("file"),
        (F.floor(F.pmod(F.col("pos"), F.lit(4096)) / 512) * 1000000).cast("long").alias("block"), "pos",
        F.posexplode("lines").alias("i", "value"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return text.repartition(n, "file", "block").sortWithinPartitions("file", "block", "pos", "i")


def _msp_view(lib):
    pk = P.parse_peaks(F.col("spectrum"))
    return lib.withColumn("p", pk).select(
        "name", F.col("ri").alias("ri"), "ion_mode", "other_metadata", F.col("num_peaks").alias("declared"), F.size("p").alias("parsed"),
        P.total(F.col("p")).alias("total"), F.size("record_issues").alias("issues"))


@query
def msp_parse(spark, sf):
    """MSP text of all orders parsed back to typed records (cast to few columns)."""
    return _msp_view(MSP.parse_lines(msp_lines(spark, sf)))


@query
def msp_embedded_repair(spark, sf):
    """Same records from text with glued NAME fields and no separators."""
    return _msp_view(MSP.parse_lines(msp_lines(spark, sf, embedded=True)))


@query
def msp_convert(spark, sf):
    """Library conversion: RI required, first record per ion mode and RI kept."""
    lib = MSP.parse_lines(msp_lines(spark, sf))
    lib = lib.withColumn("key", F.concat_ws("/", "ion_mode", F.col("ri").cast("int").cast("string"))).filter(F.col("name").isNotNull())
    lib = lib.withColumn("pos", F.regexp_extract("name", "([0-9]+)$", 1).cast("long"))
    out = MSP.convert_library(lib, "key", require_ri=True)
    return out.select("id", F.col("pos"), "known", "ri", F.size(P.parse_peaks(F.col("ei"))).alias("n_peaks"))


@query
def msp_peak_encodings(spark, sf):
    body = msp_lines(spark, sf).filter(~F.col("value").contains(": "))
    return MSP.peak_encoding_counts(body)


@query
def msp_write(spark, sf):
    """Text of the written library: characters and lines per spectrum."""
    t = MSP.msp_text(grid(spark, sf).withColumn("RI", F.col("ri")))
    return t.select(F.col("pos").alias("id"), F.length("value").alias("chars"), F.size(F.split("value", "\n")).alias("lines"),
                    F.md5("value").alias("digest"))


@query
def lc_metadata(spark, sf):
    """Typed LC metadata from text fields."""
    o = V.order_raw(spark, sf).select(
        "id", "pos", F.concat(F.col("precursor_mz").cast("decimal(12,2)").cast("string"), F.lit(" Da")).alias("PrecursorMZ"),
        F.concat(F.lit("rt "), F.col("rt").cast("int").cast("string"), F.lit(" min")).alias("retention_time"),
        F.when(F.col("ion_mode") == "O", " POS ").when(F.col("ion_mode") == "F", "Negative").otherwise("").alias("IonMode"),
        F.col("adduct").alias("PRECURSORTYPE"), F.concat(F.col("collision_energy").cast("int").cast("string"), F.lit(" eV")).alias("CE"))
    return LC.canonical_metadata(o).select(F.col("pos").alias("id"), "precursor_mz", "rt", "ion_mode", "adduct", "collision_energy")


@query
def unique_record_ids(spark, sf):
    # every seventh name ends like a suffix, so that names and suffixes meet
    name = F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit("__"), (F.col("p_partkey") % 3 + 1).cast("string"))).otherwise(F.col("p_name"))
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), name.alias("name"))
    return LC.unique_ids(p).select("pos", "id")


# --- feature tables ----------------------------------------------------------------

def feature_table(spark, sf) -> MD.FeatureTable:
    li = V.table(spark, sf, "lineitem")
    wide = (li.withColumn("v", F.concat("l_returnflag", "l_linestatus")).groupBy("l_partkey")
            .pivot("v", ["AF", "AO", "NF", "NO", "RF", "RO"]).sum("l_quantity"))
    part = V.table(spark, sf, "part")
    x = part.join(wide, F.col("p_partkey") == F.col("l_partkey"), "left")
    meta = {
        "Alignment ID": F.col("p_partkey").cast("string"), "Average Rt(min)": F.col("p_retailprice"),
        "Average RI": F.col("p_size").cast("double"), "Metabolite name": F.concat_ws(" ", "p_name", "p_brand"),
        "INCHIKEY": F.when(F.col("p_size") % 3 > 0, F.concat_ws("-", "p_brand", "p_type", F.col("p_size").cast("string"))),
        Q.TAG: F.when(F.col("p_size") % 5 == 0, "4").otherwise("1"), "Total score": F.lit(None).cast("double"),
        "RT similarity": F.lit(None).cast("double"), "EI spectrum": F.lit(None).cast("string")}
    cols = {"BLK_01": "NO", "QC_01": "NF", "STD_01": "AO", "S01": "AF", "S02": "RF", "S03": "RO"}
    data = x.select(F.col("p_partkey").alias("pos"), *[e.alias(n) for n, e in meta.items()],
                    *[F.col(v).cast("double").alias(n) for n, v in cols.items()])
    return MD.as_feature_table(data)


def _short(df, cols=()):
    return df.select(F.col("pos").alias("id"), F.col(f"`{Q.NAME}`").alias("name"), "mean", *cols)


@query
def known_dedup(spark, sf):
    t = feature_table(spark, sf)
    return _short(Q.filter_known(t.data.filter(F.col(f"`{Q.TAG}`") != "4"), ["S01", "S02", "S03"]), ["_part"]).withColumnRenamed("_part", "part")


@query
def unknown_filter(spark, sf):
    t = feature_table(spark, sf)
    return _short(Q.filter_unknown(t.data.filter(F.col(f"`{Q.TAG}`") == "4"), ["S01", "S02", "S03"], True))


@query
def blank_filter(spark, sf):
    t = feature_table(spark, sf)
    x = Q.zero_below_blank(t.data, ["S01", "S02", "S03"], ["BLK_01"], 1.0)
    return x.select(F.col("pos").alias("id"), "blank_mean", "S01", "S02", "S03")


@query
def nonzero_filter(spark, sf):
    t = feature_table(spark, sf)
    x = Q.zero_below_blank(t.data, ["S01", "S02", "S03"], ["BLK_01"], 1.0)
    return Q.detected_enough(x, ["S01", "S02", "S03"], 0.5).select(F.col("pos").alias("id"), F.col("nonzero"))


@query
def reference_normalize(spark, sf):
    t = feature_table(spark, sf)
    x = t.data.withColumns({"_part": F.lit(0), "mean": F.lit(1.0)})
    ref = Q.reference_values(x, "1", ["S01", "S02", "S03"])
    return Q.divide_by_reference(x, ref).select(F.col("pos").alias("id"), "S01", "S02", "S03")


@query
def quant_pipeline(spark, sf):
    r = Q.prepare_quant_data(feature_table(spark, sf), Params(), blank_factor=1.0, nonzero_ratio=0.5)
    return r.final.select(F.col("pos").alias("id"), "compound_id", "known", "mean", "S01", "S02", "S03")


# --- distances: nearest neighbours ------------------------------------------------

def _neighbours(method, k=5):
    def run(spark, sf):
        hits = nearest(grid(spark, sf), grid(spark, sf), Scorer(Params(distance_method=method), fragment_only=True), k, exclude_self=True)
        return lid(hits).select("query_id", "rank", "library_id", "distance")
    run.__name__ = f"{method}_neighbours"
    run.__doc__ = f"Five nearest spectra of every spectrum by {method} distance."
    return query(run)


for _m in ("cosine", "weighted_cosine", "hellinger", "composite", "entropy_weighted", "entropy_unweighted", "wasserstein", "ppm_wasserstein"):
    _neighbours(_m)


@query
def order_neighbours_ppm(spark, sf):
    """ppm-aligned weighted cosine of all orders inside 200 ppm precursor bands."""
    p = lc_default_params(distance_method="weighted_cosine")
    plan = LCSearchPlan(precursor_ppm=200.0, require_ion_mode=False)
    o = V.order_raw(spark, sf).withColumn("frag", P.tic_normalize(F.col("peaks"))).drop("peaks").persist()
    q, lib = LC.with_bands(o, o, 200.0)
    hits = nearest(q, lib, Scorer(p, fragment_only=True), 3, exclude_self=True, gate=LC.cell_gate(plan), gate_columns=("precursor_mz",), bucket="band")
    return lid(hits).select("query_id", "rank", "library_id", "distance")


@query
def distance_profile(spark, sf):
    """Row summary of the full combined distance table."""
    x = S.row_profile(built(spark, sf), Params(distance_method="cosine"))
    return lid(x).select("query_id", "n", "mean_distance", "low", "high")


@query
def close_pairs(spark, sf):
    """Unordered pairs with cosine distance below 0.22."""
    x = S.pairs_within(grid(spark, sf), Params(distance_method="cosine"), 0.22, fragment_only=True)
    return lid(x).select("query_id", "library_id", "distance")


SPLIT = Params(distance_method="cosine", use_split_loss=True, use_mref_confidence=True)


@query
def split_neighbours(spark, sf):
    """Split derived channels with reference-mass confidence weights."""
    x = nearest(built(spark, sf, SPLIT), built(spark, sf, SPLIT), Scorer(SPLIT), 3, exclude_self=True)
    return lid(x).select("query_id", "rank", "library_id", "distance")


@query
def typical_blend_neighbours(spark, sf):
    p = Params(use_typical_loss=True, loss_typical_ppm=1200.0, distance_method="cosine")
    x = nearest(built(spark, sf, p), built(spark, sf, p), Scorer(p), 3, exclude_self=True)
    return lid(x).select("query_id", "rank", "library_id", "distance")


@query
def component_shares(spark, sf):
    """Components of each spectrum's best hit."""
    p = Params(distance_method="cosine")
    b = built(spark, sf)
    best = nearest(b, b, Scorer(p), 1, exclude_self=True).drop("distance", "rank")
    x = X.pair_breakdown(best, b, b, p)
    return lid(x).select("query_id", "library_id", "distance", "d_frag", "d_loss", "c_frag_total", "c_loss_total")


@query
def component_long(spark, sf):
    """The same components, molten."""
    p = Params(distance_method="cosine")
    b = built(spark, sf)
    best = nearest(b, b, Scorer(p), 1, exclude_self=True).drop("distance", "rank")
    x = X.melt_components(X.pair_breakdown(best, b, b, p), ["d_frag", "d_loss", "c_frag_total"], upper_only=True)
    return lid(x).select("query_id", "library_id", "component", "value")


@query
def composite_direction(spark, sf):
    """Directional spread of the composite distance over best cosine pairs."""
    g = grid(spark, sf)
    best = nearest(g, g, Scorer(Params(distance_method="cosine"), fragment_only=True), 1, exclude_self=True).drop("distance", "rank")
    sc = Scorer(Params(distance_method="composite"), fragment_only=True)
    ab = S.score_pairs(best, g, g, sc).withColumnRenamed("distance", "d_ab")
    back = best.select(F.col("library_id").alias("query_id"), F.col("l_pos").alias("q_pos"), F.col("query_id").alias("library_id"), F.col("q_pos").alias("l_pos"))
    ba = S.score_pairs(back, g, g, sc).select(F.col("l_pos").alias("q_pos"), F.col("distance").alias("d_ba"))
    return lid(ab.join(ba, "q_pos")).select("query_id", "library_id", "d_ab", "d_ba")


@query
def sinkhorn_best_pairs(spark, sf):
    """Finite-iteration transport of each best cosine pair, exact value beside it."""
    g = grid(spark, sf)
    best = nearest(g, g, Scorer(Params(distance_method="cosine"), fragment_only=True), 1, exclude_self=True).drop("distance", "rank")
    a = S.score_pairs(best, g, g, Scorer(Params(distance_method="ppm_wasserstein", ot_method="sinkhorn"), fragment_only=True))
    e = S.score_pairs(best, g, g, Scorer(Params(distance_method="ppm_wasserstein"), fragment_only=True))
    return lid(a.withColumnRenamed("distance", "approximate").join(e.select("q_pos", F.col("distance").alias("exact")), "q_pos")).select(
        "query_id", "library_id", "approximate", "exact")


# --- search -------------------------------------------------------------------------

@query
def library_search(spark, sf):
    """Flagship: combined cosine search, five best library spectra per query."""
    b = built(spark, sf)
    x = S.search_library(b, b, Params(distance_method="cosine"), 5, metadata=("label",), exclude_self=True)
    return lid(x).select("query_id", "rank", "library_id", "similarity", "delta_ri", "label")


@query
def ri_band_search(spark, sf):
    """Search inside a retention-index window of 25."""
    b = built(spark, sf)
    x = S.search_library(b, b, Params(distance_method="cosine"), 5, ri_tolerance=25.0, exclude_self=True)
    return lid(x).select("query_id", "rank", "library_id", "similarity", "delta_ri")


@query
def rerank_topk(spark, sf):
    """Weighted entropy keeps 20, exact transport ranks the best 5."""
    g = grid(spark, sf)
    x = S.search_topk_rerank(g, g, Params(), first_pass_top_k=20, final_top_k=5, exclude_self=True, fragment_only=True)
    return lid(x).select("query_id", "rank", "library_id", "distance", "first_pass_distance", "first_pass_rank")


@query
def sparse_bin_search(spark, sf):
    """Bin-product backend on the log grid."""
    p = Params(distance_method="cosine")
    x = SP.search_bins(grid(spark, sf), grid(spark, sf), p, top_k=6, use_loss=False)
    return lid(x).select("query_id", "rank", "library_id", "distance")


@query
def indexed_bin_search(spark, sf):
    """Inverted bin index: every order spectrum against all of them, only promising pairs scored."""
    s = V.order_raw(spark, sf).withColumn("frag", F.col("peaks"))
    x = BI.search_indexed(s, s, Params(distance_method="cosine"), top_k=5, use_loss=False)
    return lid(x).select("query_id", "rank", "library_id", "distance")


@query
def smeared_bins(spark, sf):
    g = SP.BinGrid.from_params(Params())
    x = SP.smeared_bins(grid(spark, sf), g)
    return x.groupBy(F.col("pos").alias("id")).agg(F.count("*").alias("n_bins"), F.sum("value").alias("total"),
                                                   F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))


PLAN = LCSearchPlan(precursor_ppm=200.0, rt_window=600.0, require_ion_mode=True, require_adduct=True, collision_energy_tolerance=20.0,
                    exclude_same_id=True, missing_metadata="exclude")


@query
def lc_candidate_audit(spark, sf):
    o = V.order_raw(spark, sf)
    x = LC.candidate_audit(o, o, PLAN)
    return lid(x)


LC_PLAN = LCSearchPlan(precursor_ppm=200.0, require_ion_mode=True, exclude_same_id=True, missing_metadata="exclude",
                       first_pass_method="entropy_weighted", rerank_method="cosine", first_pass_top_k=10, final_top_k=3)


@query
def lc_search(spark, sf):
    """Gated two-stage search over all orders."""
    o = V.order_raw(spark, sf).withColumn("frag", P.tic_normalize(F.col("peaks"))).drop("peaks").persist()
    x = LC.search_lc_library(o, o, LC_PLAN, lc_default_params())
    return lid(x).select("query_id", "rank", "library_id", "distance", "first_pass_distance")


@query
def topk_accuracy(spark, sf):
    g = grid(spark, sf)
    hits = nearest(g, g, Scorer(Params(distance_method="cosine"), fragment_only=True), 5, exclude_self=True)
    return M.topk_accuracy(hits, g.select("id", F.col("prefix").alias("group")), 5)


@query
def rerank_quality(spark, sf):
    """Candidate retention and final rank of each spectrum's cosine neighbour."""
    g = grid(spark, sf)
    best = nearest(g, g, Scorer(Params(distance_method="cosine"), fragment_only=True), 1, exclude_self=True).select("query_id", "library_id")
    x = S.search_topk_rerank(g, g, Params(), "hellinger", "entropy_unweighted", 10, 5, exclude_self=True, fragment_only=True)
    cand = nearest(g, g, Scorer(Params(distance_method="hellinger"), fragment_only=True), 10, exclude_self=True)
    return B.rerank_evaluation(g, cand, x, best)


# --- similarity graph and clusters ----------------------------------------------------

@query
def analog_graph(spark, sf):
    p = Params(distance_method="cosine", ri_mode_analog="hard", analog_k=3)
    x = SI.analog_graph(grid(spark, sf), p, fragment_only=True)
    return x.select("a_pos", "b_pos", "similarity")


@query
def analog_graph_soft(spark, sf):
    p = Params(distance_method="cosine", ri_mode_analog="soft", analog_k=2, ri_sigma=200.0)
    return SI.analog_graph(grid(spark, sf), p, fragment_only=True).select("a_pos", "b_pos", "similarity")


@query
def density_clusters(spark, sf):
    x = CL.cluster_density(grid(spark, sf), Params(distance_method="cosine"), eps=0.28, min_pts=3, fragment_only=True)
    return x.select(F.col("pos").alias("id"), "cluster")


@query
def density_clusters_hard(spark, sf):
    """Density clusters at the standard cut, with the RI window as a hard penalty."""
    p = Params(distance_method="cosine", ri_mode_cluster="hard", ri_window_hard=40.0)
    return CL.cluster_density(grid(spark, sf), p, min_pts=3, fragment_only=True).select(F.col("pos").alias("id"), "cluster")


@query
def density_clusters_soft(spark, sf):
    """Density clusters at a second cut, with similarities that fall off with the RI gap."""
    p = Params(distance_method="cosine", ri_mode_cluster="soft", ri_sigma=60.0)
    return CL.cluster_density(grid(spark, sf), p, eps=0.4, min_pts=4, fragment_only=True).select(F.col("pos").alias("id"), "cluster")


@query
def core_spectra(spark, sf):
    """Core flag of density clustering: neighbours within the cut, self included."""
    return CL.near_counts(grid(spark, sf), Params(distance_method="cosine"), 0.28, True).select(F.col("pos").alias("id"), F.col("n_near").alias("n_near"))


@query
def connected_orders(spark, sf):
    """Connected groups of customers and parts linked by all order lines."""
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), (F.col("l_partkey") + 1000000000).alias("b"))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return CL.connected_groups(e, nodes).select(F.col("node"), F.col("group").alias("component"))


@query
def embedding_coordinates(spark, sf):
    """Two coordinates per spectrum from the neighbour graph of all spectra."""
    return LO.embed(grid(spark, sf), Params(distance_method="cosine"), fragment_only=True).select(F.col("pos").alias("id"), "V1", "V2")


@query
def neighbour_graph(spark, sf):
    """Membership strengths of the fuzzy neighbour graph, each edge in both directions."""
    return LO.neighbour_graph(grid(spark, sf), Params(distance_method="cosine"), fragment_only=True)


@query
def neighbour_graph_soft(spark, sf):
    """The same graph with six neighbours and similarities that fall off with the RI gap."""
    p = Params(distance_method="cosine", ri_mode_cluster="soft", ri_sigma=60.0)
    return LO.neighbour_graph(grid(spark, sf), p, n_neighbors=6, fragment_only=True)


@query
def clustering_quality(spark, sf):
    g = grid(spark, sf)
    return CL.clustering_quality(g, g.select("id", F.col("prefix").alias("group")), Params(distance_method="cosine"), fragment_only=True)


@query
def nmi_ari(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_type"), F.pmod(F.col("user_id"), F.lit(6)).cast("string").alias("cluster"))
    return M.nmi_ari(e, "event_type", "cluster")


@query
def silhouette(spark, sf):
    return lid(M.silhouette(grid(spark, sf), Params(distance_method="cosine"), "label", fragment_only=True))


def clustered(spark, sf, p):
    b = built(spark, sf, p)
    cls = F.concat(F.lit("class"), (F.col("label") % 3).cast("string"))
    return b.withColumns({"cluster": F.col("label").cast("string"), "known": F.when(F.col("pos") % 4 == 0, "F").otherwise("T"),
                          "compound_class": F.when(F.col("pos") % 2 == 0, cls).otherwise(F.lit("other"))})


@query
def cluster_drivers(spark, sf):
    x = X.cluster_drivers(clustered(spark, sf, Params(distance_method="cosine")), Params(distance_method="cosine"))
    return lid(x).select("cluster", "n", "n_known", "frac_known", "RI_min", "RI_median", "RI_max", "top_class", "pairs",
                         "mean_sim_cluster", "medoid_id", "c_frag_total_mean", "c_loss_total_mean", "driver_main", "label")


@query
def cluster_drivers_split(spark, sf):
    x = X.cluster_drivers(clustered(spark, sf, SPLIT), SPLIT)
    return lid(x).select("cluster", "n", "medoid_id", "c_anchor_in_loss_mean", "c_pair_in_loss_mean", "driver_loss_sub", "label")


@query
def cluster_motifs(spark, sf):
    x = X.typical_motifs(clustered(spark, sf, TYP), TYP.loss_universe())
    return x.drop("class", "exact")


@query
def motif_labels(spark, sf):
    x = X.typical_motifs(clustered(spark, sf, TYP), TYP.loss_universe())
    return X.top_labels(x, 3)


@query
def medoids(spark, sf):
    p = Params(distance_method="cosine")
    return lid(X.medoids(X.within_cluster_sums(clustered(spark, sf, p), p)).select("cluster", "medoid_id"))


@query
def medoid_partners(spark, sf):
    p = Params(distance_method="cosine")
    c = clustered(spark, sf, p)
    med = X.medoids(X.within_cluster_sums(c, p))
    x = X.medoid_partners(c, p, med)
    return lid(x.withColumn("library_id", F.col("partner_id"))).select("cluster", "kind", "rank", F.col("library_id").alias("partner_id"), "similarity")


@query
def cluster_reports(spark, sf):
    p = Params(distance_method="cosine")
    c = clustered(spark, sf, p)
    summary = X.cluster_drivers(c, p)
    partners = X.medoid_partners(c, p, X.medoids(X.within_cluster_sums(c, p)))
    detail = X.pair_breakdown(partners.select(F.col("medoid_id").alias("query_id"), "q_pos", F.col("partner_id").alias("library_id"), "l_pos", "kind"), c, c, p)
    return X.cluster_reports(summary, partners, detail).select("cluster", "file_name", F.length("markdown").alias("n_chars"))


@query
def typical_match_table(spark, sf):
    """Shared typical losses of each spectrum with its successor."""
    b = built(spark, sf, TYP)
    nxt = b.select((F.col("pos") - 1).alias("pos"), F.col("loss_typ").alias("other"))
    pairs = b.select(F.col("pos"), "loss_typ").join(nxt, "pos").withColumnRenamed("pos", "pair_id")
    return X.match_table(pairs, "loss_typ", "other", TYP.base_losses, top_n=5)


# --- evaluation -----------------------------------------------------------------------

def keyed_pairs(spark, sf, method="cosine"):
    g = grid(spark, sf)
    d = S.AllPairs(g, Params(distance_method=method), fragment_only=True)
    return M.attach_keys(d, B.labels_of(g, "inchikey"))


@query
def replicate_consistency(spark, sf):
    return M.replicate_consistency(M.replicate_ranks(grid(spark, sf), Params(distance_method="cosine"), "inchikey", True))


@query
def precision_at_k(spark, sf):
    return M.precision_at_k(keyed_pairs(spark, sf))


@query
def library_retrieval(spark, sf):
    """Even ids search odd ids inside an RI window of 200; one label is missing from the library."""
    g = grid(spark, sf)
    q, lib = g.filter("pos % 2 = 0"), g.filter("pos % 2 = 1 and label <> 3")
    p = Params(distance_method="cosine")
    scored = B.library_pairs(q, lib, p, 200.0, True)
    return M.library_retrieval(scored, B.labels_of(q, "inchikey"), B.labels_of(lib, "inchikey"))


@query
def auc_roc(spark, sf):
    return M.auc_of_spectra(grid(spark, sf), Params(distance_method="cosine"), fragment_only=True)


@query
def ordered_auc(spark, sf):
    return M.ordered_discrimination(keyed_pairs(spark, sf, "composite"))


@query
def fdr_curve(spark, sf):
    return M.fdr_of_spectra(grid(spark, sf), Params(distance_method="cosine"), fragment_only=True)


@query
def similarity_transforms(spark, sf):
    """Mean similarity under every transform over the i < j pairs."""
    return M.similarity_summary(keyed_pairs(spark, sf))


@query
def homolog_score(spark, sf):
    g = grid(spark, sf).withColumn("compound_class", F.concat(F.lit("c"), F.col("label").cast("string")))
    return M.homolog_detection(g, Params(distance_method="cosine"), 0.65, 50.0, fragment_only=True)


@query
def homolog_groups(spark, sf):
    """Ground truth of key-prefix groups with at least three members."""
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws(
        "-", F.rpad(F.col("c_mktsegment"), 10, "X"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.col("c_name")).alias("inchikey"))
    return M.homolog_ground_truth(c, min_size=3)


@query
def event_auc(spark, sf):
    return M.rank_auc(V.scored_events(spark, sf))


@query
def roc_points(spark, sf):
    return M.roc_points(V.scored_events(spark, sf)).select(F.col("threshold"), "tp", "fp", "tpr", "fpr")


@query
def event_fdr(spark, sf):
    e = V.scored_events(spark, sf).withColumn("similarity", F.col("score") / 49002.0)
    return M.fdr_curve(e)


def event_lists(spark, sf):
    """Each user's events as a ranked list with many ties; purchases are relevant."""
    e = V.scored_events(spark, sf)
    return e.select(F.col("user_id").alias("q_pos"), F.col("event_id").alias("l_pos"), F.floor(F.col("score") / 5000).cast("double").alias("distance"),
                    F.col("positive").alias("relevant"))


@query
def tie_aware_first(spark, sf):
    return M.tie_aware_queries(event_lists(spark, sf))


@query
def tie_aware_precision(spark, sf):
    return M.tie_aware_precision(event_lists(spark, sf))


@query
def tie_diagnostics(spark, sf):
    return M.tie_diagnostics(event_lists(spark, sf))


def coarse_lists(spark, sf):
    """The same lists with purchases and clicks relevant."""
    e = V.scored_events(spark, sf)
    return e.select(F.col("user_id").alias("q_pos"), F.floor(F.col("score") / 5000).cast("double").alias("distance"),
                    F.col("event_type").isin("purchase", "click").alias("relevant"))


@query
def tie_sensitivity(spark, sf):
    return TI.tie_sensitivity(event_lists(spark, sf), coarse_lists(spark, sf))


@query
def tie_effects(spark, sf):
    return TI.tie_effects(event_lists(spark, sf), coarse_lists(spark, sf))


@query
def single_target(spark, sf):
    x = event_lists(spark, sf)
    target = x.groupBy("q_pos").agg(F.min("l_pos").alias("l_pos"))
    return M.single_target_metrics(x, target)


@query
def bootstrap_means(spark, sf):
    e = V.table(spark, sf, "events")
    return ST.bootstrap_ci(e.select("event_type", "user_id", "value"), "value", ["event_type"], unit="user_id", n_boot=200)


@query
def discordant_methods(spark, sf):
    """Top-1 agreement of methods with exact transport as the reference."""
    g = grid(spark, sf)
    out = []
    for m in ("cosine", "hellinger", "ppm_wasserstein"):
        h = nearest(g, g, Scorer(Params(distance_method=m), fragment_only=True), 1, exclude_self=True)
        k = g.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), g.select(F.col("id").alias("library_id"), F.col("label").alias("ll"))
        out.append(h.join(k[0], "query_id").join(k[1], "library_id").select("query_id", F.lit(m).alias("method"), (F.col("ql") == F.col("ll")).alias("hit")))
    return ST.with_mcnemar(ST.discordant_counts(B.union_all(out), "method", "hit", "query_id", "ppm_wasserstein"))


@query
def replicate_summary(spark, sf):
    e = V.table(spark, sf, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"), "value")
    return ST.replicate_summary(e, ["event_type"], "value")


@query
def class_metrics(spark, sf):
    """Top-1 hits by query label, and how failures distribute over hit labels."""
    g = grid(spark, sf)
    h = nearest(g, g, Scorer(Params(distance_method="cosine"), fragment_only=True), 1, exclude_self=True)
    x = (h.join(g.select(F.col("id").alias("query_id"), F.col("label").alias("truth")), "query_id")
         .join(g.select(F.col("id").alias("library_id"), F.col("label").alias("found")), "library_id").withColumn("method", F.lit("cosine")))
    return ST.failure_confusion(x.filter("truth <> found"), "method", "truth", "found")


@query
def backend_agreement(spark, sf):
    """Exact and sparse exact transport give one answer and one ranking."""
    g = grid(spark, sf)
    a = S.AllPairs(g, Params(distance_method="ppm_wasserstein", ot_method="exact"), fragment_only=True)
    b = S.AllPairs(g, Params(distance_method="ppm_wasserstein", ot_method="exact_sparse"), fragment_only=True)
    return ST.backend_agreement(a, b)


@query
def noise_robustness(spark, sf):
    return B.noise_robustness(grid(spark, sf), Params(), ["cosine", "ppm_wasserstein"], (0.0, 20.0), 1)


@query
def ablation_study(spark, sf):
    return B.ablation(built(spark, sf), Params(distance_method="cosine"))


@query
def param_sweep(spark, sf):
    """Two noise cuts x two methods."""
    raw = V.grid_raw(spark, sf)
    return B.sweep_params(raw, Params(), {"noise_thr": [0.01, 0.1]}, ["cosine", "hellinger"]).drop("settings")


@query
def capped_sample(spark, sf):
    """Seeded sampling of at most five orders per customer."""
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"))
    return SA.sample_per_group(o, "grp", 5, 11).groupBy("grp").agg(F.count("*").alias("n"))

