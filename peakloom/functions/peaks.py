"""Peak-list expressions.

A spectrum is one ``array<struct<mz,intensity>>`` column.  Every function here
maps Columns to Columns with Spark's array functions, so spectrum preparation is
a narrow projection: no shuffle and no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ..schema import PEAKS_DDL


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def peak(mz, intensity) -> Column:
    return F.struct(mz.alias("mz"), intensity.alias("intensity"))


def empty_peaks() -> Column:
    return F.array().cast(PEAKS_DDL)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def total(peaks: Column) -> Column:
    return F.aggregate(peaks, F.lit(0.0), lambda acc, p: acc + p["intensity"])


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def sort_by_mz(peaks: Column) -> Column:
    """Stable sort on m/z: equal m/z keep their input order."""
    keyed = F.transform(peaks, lambda p, i: F.struct(p["mz"].alias("k"), i.alias("i"),
                                                     p["intensity"].alias("v")))
    return F.transform(F.array_sort(keyed), lambda p: peak(p["k"], p["v"]))


def by_intensity(peaks: Column, n) -> Column:
    """The n most intense peaks, ties in input order, most intense first."""
    keyed = F.transform(peaks, lambda p, i: F.struct((-p["intensity"]).alias("k"), i.alias("i"),
                                                     p["mz"].alias("mz")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda p: peak(p["mz"], -p["k"]))


def clean_peaks(peaks: Column) -> Column:
    """Keep finite positive peaks, sorted by m/z; NULL becomes the empty list."""
    kept = F.filter(peaks, lambda p: is_finite(p["mz"]) & is_finite(p["intensity"])
                    & (p["mz"] > 0) & (p["intensity"] > 0))
    return F.coalesce(sort_by_mz(kept), empty_peaks())


def parse_peaks(text: Column) -> Column:
    """``"mz:int mz:int"`` to a clean peak list."""
    tokens = F.split(text, " ")
    pairs = F.transform(tokens, lambda t: peak(
        F.regexp_replace(t, ":.*$", "").try_cast("double"),
        F.regexp_replace(t, "^.*:", "").try_cast("double")))
    return clean_peaks(F.when(F.length(text) > 0, pairs).otherwise(empty_peaks()))


def format_peaks(peaks: Column) -> Column:
    return F.array_join(F.transform(peaks, lambda p: F.concat(
        p["mz"].cast("string"), F.lit(":"), p["intensity"].cast("string"))), " ")


def normalize(peaks: Column) -> Column:
    """Scale intensities to sum 1; an all-zero list stays as it is."""
    return let(peaks, lambda ps: let(total(ps), lambda s: F.when(
        s > 0, F.transform(ps, lambda p: peak(p["mz"], p["intensity"] / s))).otherwise(ps)))


def tic_normalize(peaks: Column) -> Column:
    return normalize(clean_peaks(peaks))


def merge_close(peaks: Column, ppm) -> Column:
    """Left fold over sorted peaks; a group holds every peak within ``ppm`` of its
    first m/z and becomes one peak (intensity-weighted m/z, summed intensity)."""
    ppm = ppm if isinstance(ppm, Column) else F.lit(float(ppm))
    zero = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0.0).alias("w"),
                    F.lit(0.0).alias("m"), empty_peaks().alias("done"))

    def closed(acc):
        return F.when(acc["anchor"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(peak(acc["m"] / acc["w"], acc["w"]))))

    def step(acc, p):
        joins = F.coalesce(F.abs(p["mz"] - acc["anchor"]) <= acc["anchor"] * ppm * 1e-6, F.lit(False))
        mass = p["mz"] * p["intensity"]
        return F.struct(
            F.when(joins, acc["anchor"]).otherwise(p["mz"]).alias("anchor"),
            F.when(joins, acc["w"] + p["intensity"]).otherwise(p["intensity"]).alias("w"),
            F.when(joins, acc["m"] + mass).otherwise(mass).alias("m"),
            F.when(joins, acc["done"]).otherwise(closed(acc)).alias("done"),
        )

    return F.aggregate(peaks, zero, step, closed)


def has_close(peaks: Column, ppm) -> Column:
    """True when any neighbouring pair lies within ``ppm`` (only then is a merge needed)."""
    return F.exists(F.zip_with(peaks, F.slice(peaks, 2, F.greatest(F.size(peaks) - 1, F.lit(0))),
                               lambda a, b: F.coalesce(b["mz"] - a["mz"] <= a["mz"] * ppm * 1e-6,
                                                       F.lit(False))), lambda x: x)


def prep_peaks(peaks: Column, p) -> Column:
    """Range and noise filter, centroid, keep the strongest ``topK``, normalise."""
    ranged = F.filter(peaks, lambda x: (x["mz"] >= p.min_mz) & (x["mz"] <= p.max_mz))
    denoised = let(ranged, lambda r: let(
        F.array_max(F.transform(r, lambda x: x["intensity"])),
        lambda top: F.filter(r, lambda x: x["intensity"] >= top * p.noise_thr)))
    merged = let(denoised, lambda d: let(sort_by_mz(d), lambda s: F.when(
        has_close(s, p.centroid_ppm), merge_close(s, p.centroid_ppm)).otherwise(s)))
    kept = let(merged, lambda m: F.when(
        F.size(m) > p.topK, F.array_sort(by_intensity(m, p.topK))).otherwise(m))
    out = normalize(kept)
    if p.use_sqrt:
        out = normalize(F.transform(out, lambda x: peak(x["mz"], F.sqrt(x["intensity"]))))
    return F.coalesce(out, empty_peaks())


def intensity_at(peaks: Column, target: float, ppm: float, strict: bool = False) -> Column:
    """Strongest intensity within ``ppm`` of ``target``; 0 when there is none."""
    tol = target * ppm * 1e-6

    def near(x):
        gap = F.abs(x["mz"] - target)
        return gap < tol if strict else gap <= tol

    return F.coalesce(F.array_max(F.transform(F.filter(peaks, near), lambda x: x["intensity"])),
                      F.lit(0.0))


def downweight(peaks: Column, targets, ppm: float, weight: float) -> Column:
    """Multiply intensities once per target mass they match (compounding)."""
    if not targets or weight is None or not 0 <= weight <= 1:
        return peaks

    def factor(mz):
        out = F.lit(1.0)
        for t in targets:
            out = out * F.when(F.abs(mz - t) <= t * ppm * 1e-6, F.lit(float(weight))).otherwise(1.0)
        return out

    return F.transform(peaks, lambda x: peak(x["mz"], x["intensity"] * factor(x["mz"])))


def downweight_normalized(peaks: Column, targets, ppm: float, weight: float) -> Column:
    if not targets or weight is None or not 0 <= weight <= 1:
        return peaks
    return normalize(downweight(peaks, targets, ppm, weight))


# --- derivatization ------------------------------------------------------

def detect_derivatization(frag: Column, p) -> Column:
    """Struct(type, score_tms, score_tbdms, i73, i147, i115, i57)."""
    ppm, allowed = p.diagnostic_ppm, p.deriv_allowed
    zero = F.lit(0.0)
    tms = [intensity_at(frag, m, ppm) if allowed in ("TMS", "BOTH") else zero for m in C.TMS_IONS]
    tbd = [intensity_at(frag, m, ppm) if allowed in ("TBDMS", "BOTH") else zero for m in C.TBDMS_IONS]
    ions = F.struct(*[c.alias(n) for c, n in zip(tms + tbd, ("i73", "i147", "i115", "i57"))])
    return let(ions, lambda s: derivatization_call(
        s["i73"], s["i147"], s["i115"], s["i57"],
        p.derivatization_auto_min_int, p.derivatization_auto_strong_int))


def derivatization_call(i73, i147, i115, i57, min_int, strong_int) -> Column:
    low, strong = F.lit(float(min_int)), F.lit(float(strong_int))
    tms_hit = (i73 >= low) & ((i147 >= low / 2) | (i73 >= strong))
    tbd_hit = (i115 >= low) & ((i57 >= low / 2) | (i115 >= strong))
    s_tms, s_tbd = i73 + 0.5 * i147, i115 + 0.2 * i57
    kind = (F.when(tms_hit & (~tbd_hit | (s_tms >= s_tbd)), "TMS")
            .when(tbd_hit, "TBDMS").otherwise("none"))
    return F.struct(kind.alias("type"), s_tms.alias("score_tms"), s_tbd.alias("score_tbdms"),
                    i73.alias("i73"), i147.alias("i147"), i115.alias("i115"), i57.alias("i57"))


def loss_table(rows) -> Column:
    """A loss table as an array literal of struct(idx, exact, formula, cls)."""
    if not rows:
        return F.expr("cast(array() as array<struct<idx:int,exact:double,formula:string,cls:string>>)")
    items = ", ".join(
        f"named_struct('idx', {i}, 'exact', {exact!r}D, 'formula', '{formula}', 'cls', '{cls}')"
        for i, (_, exact, formula, cls) in enumerate(rows))
    return F.expr(f"array({items})")


# --- reference mass ------------------------------------------------------

def detected_losses(frag: Column, losses: Column, ppm: float) -> Column:
    """Strong peaks near the top of the spectrum that reach its heaviest m/z by a
    known loss; one struct per (loss, peak), in loss-table order."""
    def search(top):
        strong = F.filter(frag, lambda x: (F.abs(x["mz"] - top) <= 50) & (x["intensity"] > 0.02))

        def per_loss(loss):
            def reaches(x):
                m = x["mz"] + loss["exact"]
                return F.abs(m - top) <= F.greatest(m * ppm * 1e-6 * 3, F.lit(1.0))
            return F.transform(F.filter(strong, reaches), lambda x: F.struct(
                loss["formula"].alias("formula"), loss["cls"].alias("cls"),
                loss["exact"].alias("exact_loss"), x["mz"].alias("from_peak"),
                (x["mz"] + loss["exact"]).alias("to_mref"), x["intensity"].alias("intensity"),
                (F.abs(x["mz"] + loss["exact"] - top) / top * 1e6).alias("ppm_error")))

        return F.flatten(F.transform(losses, per_loss))

    return let(F.array_max(F.transform(frag, lambda x: x["mz"])), search)


def reference_mass(frag: Column, detected: Column) -> Column:
    """Largest candidate mass.  Every candidate that is itself a peak is at most the
    heaviest m/z, so only that m/z and the peak-plus-loss sums can win."""
    return F.greatest(F.array_max(F.transform(frag, lambda x: x["mz"])),
                      F.array_max(F.transform(detected, lambda d: d["to_mref"])))


def reference_confidence(frag: Column, detected: Column, p) -> Column:
    w = [p.mref_conf_w_nloss, p.mref_conf_w_intensity, p.mref_conf_w_hi]
    w = [x / sum(w) for x in w] if sum(w) > 0 else [1.0, 0.0, 0.0]

    def capped(value, ref):
        return F.least(F.lit(1.0), value / F.lit(float(ref))) if ref > 0 else F.lit(0.0)

    n_score = capped(F.size(detected).cast("double"), p.mref_conf_nloss_ref)
    i_score = capped(array_total(F.transform(detected, lambda d: d["intensity"])), p.mref_conf_int_ref)
    hi = F.lit(0.0)
    if p.mref_conf_hi_window > 0:
        hi = let(F.array_max(F.transform(frag, lambda x: x["mz"])), lambda top: F.coalesce(
            F.array_max(F.transform(F.filter(frag, lambda x: x["mz"] > top - p.mref_conf_hi_window),
                                    lambda x: x["intensity"])), F.lit(0.0)))
    h_score = capped(hi, p.mref_conf_hi_int_ref)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), w[0] * n_score + w[1] * i_score + w[2] * h_score))
    return F.when(F.size(frag) == 0, 0.0).otherwise(score)


# --- derived mass-difference spectra --------------------------------------

def in_range(peaks: Column, p) -> Column:
    return F.filter(peaks, lambda x: (x["mz"] >= p.loss_min) & (x["mz"] <= p.loss_max))


def anchored_differences(frag: Column, mref: Column, p, confidence: Column | None = None) -> Column:
    scale = F.lit(1.0)
    if p.use_mref_confidence and confidence is not None:
        scale = F.pow(confidence, F.lit(float(p.mref_conf_power)))
    return in_range(F.transform(frag, lambda x: peak(mref - x["mz"], x["intensity"] * scale)), p)


def pairwise_differences(frag: Column, p) -> Column:
    """|mz_i - mz_j| of the strongest peaks with intensity min(int_i, int_j), i < j."""
    top = by_intensity(frag, p.loss_top_peaks)
    diffs = let(top, lambda t: F.flatten(F.transform(t, lambda a, i: F.transform(
        F.slice(t, i + 2, F.lit(p.loss_top_peaks)),
        lambda b: peak(F.abs(a["mz"] - b["mz"]), F.least(a["intensity"], b["intensity"]))))))
    return in_range(diffs, p)


def sum_by_bin(peaks: Column) -> Column:
    """Sum intensities per m/z rounded to 3 decimals, sorted by m/z."""
    binned = F.array_sort(F.transform(peaks, lambda x: peak(F.bround(x["mz"], 3), x["intensity"])))
    zero = F.struct(F.lit(None).cast("double").alias("mz"), F.lit(0.0).alias("w"),
                    empty_peaks().alias("done"))

    def closed(acc):
        return F.when(acc["mz"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(peak(acc["mz"], acc["w"]))))

    def step(acc, x):
        same = F.coalesce(acc["mz"] == x["mz"], F.lit(False))
        return F.struct(x["mz"].alias("mz"),
                        F.when(same, acc["w"] + x["intensity"]).otherwise(x["intensity"]).alias("w"),
                        F.when(same, acc["done"]).otherwise(closed(acc)).alias("done"))

    return F.aggregate(binned, zero, step, closed)


def summarize_differences(peaks: Column, p) -> Column:
    """Bin, keep the ``loss_max_peaks`` strongest, sort by m/z, normalise; no mass = empty."""
    kept = let(sum_by_bin(peaks), lambda b: F.when(
        F.size(b) > p.loss_max_peaks, F.array_sort(by_intensity(b, p.loss_max_peaks))).otherwise(b))
    return let(kept, lambda k: F.when(total(k) > 0, normalize(k)).otherwise(empty_peaks()))


# --- typical-loss projection ----------------------------------------------

def project_typical(peaks: Column, losses: Column, ppm: float, deriv_weight: float = 1.0,
                    keep_zeros: bool = False) -> Column:
    """Move each peak onto its nearest known loss within ppm of the observed m/z.

    Returns array<struct<mz,intensity,formula>> sorted by exact mass.
    """
    if ppm is None or ppm <= 0:
        raise ValueError("ppm must be > 0")
    w = float(deriv_weight) if deriv_weight is not None and 0 <= deriv_weight <= 1 else 1.0

    def nearest(x):
        tol = x["mz"] * ppm * 1e-6
        return F.array_min(F.transform(
            F.filter(losses, lambda l: F.abs(l["exact"] - x["mz"]) <= tol),
            lambda l: F.struct(F.abs(l["exact"] - x["mz"]).alias("gap"), l["idx"].alias("idx"))))["idx"]

    assigned = F.filter(F.transform(peaks, lambda x: F.struct(
        nearest(x).alias("idx"), x["intensity"].alias("v"))), lambda a: a["idx"].isNotNull())

    def onto(asg):
        rows = F.transform(losses, lambda l: F.struct(
            l["exact"].alias("mz"),
            (array_total(F.transform(F.filter(asg, lambda a: a["idx"] == l["idx"]), lambda a: a["v"]))
             * F.when(l["cls"].startswith("deriv_"), w).otherwise(1.0)).alias("intensity"),
            l["formula"].alias("formula")))
        return let(rows, lambda r: let(total(r), lambda s: F.when(s > 1e-12, F.array_sort(
            F.filter(F.transform(r, lambda x: F.struct(
                x["mz"].alias("mz"), (x["intensity"] / s).alias("intensity"),
                x["formula"].alias("formula"))),
                lambda x: F.lit(keep_zeros) | (x["intensity"] > 0))))))

    empty = F.array().cast("array<struct<mz:double,intensity:double,formula:string>>")
    return F.coalesce(let(assigned, onto), empty)


# --- compound classes -----------------------------------------------------

def detect_class(frag: Column, ppm: float = 15.0, rules: dict | None = None) -> Column:
    """Up to three class names joined by ';', strongest evidence first."""
    r = {**C.CLASS_RULES, **(rules or {})}
    ions = [43.0548, 57.0704, 71.0861, 85.1017, 99.1174, 41.0391, 55.0548, 69.0704, 83.0861,
            77.0391, 78.0470, 91.0548, 93.0704, 136.1252, 161.1330, 204.1878, 43.0184, 58.0419,
            44.0262, 29.0027, 44.0626, 31.0184, 45.0340, 61.0290, 46.9955, 48.0034, 68.0262,
            39.0235, 68.0626]
    name = {m: f"i{int(round(m * 1e4))}" for m in ions}
    seen = F.struct(*[intensity_at(frag, m, ppm, strict=True).alias(name[m]) for m in ions])

    def call(s):
        def at(m):
            return s[name[m]]

        def count(masses, floor):
            return sum((at(m) > floor).cast("int") for m in masses)

        ketone = (at(43.0184) > r["methyl_ketone_43_min_int"]) & (at(58.0419) > r["methyl_ketone_58_min_int"])
        checks = [
            ("alkane", count(ions[:5], r["alkane_min_int"]) >= r["alkane_count"], at(57.0704)),
            ("alkene", (count(ions[5:9], r["alkene_min_int"]) >= r["alkene_count"])
             & (at(41.0391) > r["alkene_41_min_int"]), at(41.0391)),
            ("aromatic", (at(77.0391) > r["aromatic_77_min_int"]) | (at(78.0470) > r["aromatic_78_min_int"]),
             F.greatest(at(77.0391), at(78.0470))),
            ("alkylbenzene", at(91.0548) > r["alkylbenzene_91_min_int"], at(91.0548)),
            ("monoterpene_HC", (at(93.0704) > r["monoterpene_93_min_int"])
             & (at(136.1252) > r["monoterpene_136_min_int"]), at(93.0704)),
            ("sesquiterpene", (at(161.1330) > r["sesquiterpene_161_min_int"])
             & (at(204.1878) > r["sesquiterpene_204_min_int"]), at(161.1330)),
            ("methyl_ketone", ketone, at(43.0184)),
            ("acetyl_compound", (at(43.0184) > r["acetyl_43_min_int"])
             & (at(43.0184) > at(43.0548) * r["acetyl_ratio"]) & ~ketone, at(43.0184)),
            ("aldehyde", (at(44.0262) > r["aldehyde_44_min_int"]) & (at(29.0027) > r["aldehyde_29_min_int"])
             & ((at(44.0262) > at(44.0626) * r["aldehyde_44hydro_ratio"])
                | ~(at(44.0626) > r["aldehyde_44hydro_min_int"])), at(44.0262)),
            ("alcohol", (at(31.0184) > r["alcohol_31_min_int"]) & (at(45.0340) > r["alcohol_45_min_int"]),
             at(31.0184) + at(45.0340)),
            ("acetate_ester", (at(43.0184) > r["acetate_43_min_int"]) & (at(61.0290) > r["acetate_61_min_int"]),
             at(43.0184)),
            ("sulfur_compound", (at(46.9955) > r["sulfur_47_min_int"]) | (at(48.0034) > r["sulfur_47_min_int"]),
             F.greatest(at(46.9955), at(48.0034))),
            ("furan", (at(68.0262) > r["furan_68_min_int"]) & (at(39.0235) > r["furan_39_min_int"])
             & (~(at(68.0626) > r["furan_68hydro_min_int"]) | (at(68.0262) > at(68.0626))), at(68.0262)),
        ]
        found = F.filter(F.array(*[F.when(ok, F.struct((-conf).alias("k"), F.lit(i).alias("i"),
                                                       F.lit(label).alias("label")))
                                   for i, (label, ok, conf) in enumerate(checks)]),
                         lambda x: x.isNotNull())
        return let(found, lambda f: F.when(F.size(f) == 0, "unclassified").otherwise(
            F.array_join(F.transform(F.slice(F.array_sort(f), 1, 3), lambda x: x["label"]), ";")))

    return F.when(F.size(frag) == 0, "unknown").otherwise(let(seen, call))


# --- weighting ------------------------------------------------------------

def mz_bin(mz: Column, width: float) -> Column:
    return F.round(F.floor(mz / width) * width + width / 2, 6)


def weight_peaks(peaks: Column, frequency: Column | None, intensity_power: float = 0.5,
                 freq_power: float = 0.5, bin_width: float = 1.0) -> Column:
    """intensity^a * freq^b, renormalised; an all-zero result keeps the raw shape.

    ``frequency`` is a map<double,double> of bin centre to share of spectra."""
    def weighted(x):
        v = F.when(is_finite(x["intensity"]) & (x["intensity"] > 0), x["intensity"]).otherwise(0.0)
        v = F.pow(v, F.lit(float(intensity_power)))
        if frequency is not None:
            share = F.coalesce(F.try_element_at(frequency, mz_bin(x["mz"], bin_width)), F.lit(0.0))
            v = v * F.pow(share, F.lit(float(freq_power)))
        return peak(x["mz"], v)

    return let(F.transform(peaks, weighted), lambda w: F.when(
        total(w) > 0, normalize(w)).otherwise(normalize(peaks)))


def rescale(peaks: Column, mode: str = "max") -> Column:
    """Intensities scaled so the maximum (or the sum) is 100."""
    values = F.transform(peaks, lambda x: x["intensity"])
    ref = F.array_max(values) if mode == "max" else array_total(values)
    return let(ref, lambda s: F.transform(peaks, lambda x: peak(
        x["mz"], F.when(s > 0, x["intensity"] / s * 100).otherwise(x["intensity"]))))


def mark_shared(peaks: Column, other: Column, ppm: float) -> Column:
    """array<struct<mz,intensity,shared>>: does ``other`` hold a peak within mz*ppm?"""
    return F.transform(peaks, lambda x: F.struct(
        x["mz"].alias("mz"), x["intensity"].alias("intensity"),
        F.exists(other, lambda y: F.abs(y["mz"] - x["mz"]) <= x["mz"] * ppm * 1e-6).alias("shared")))
