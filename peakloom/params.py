"""Typed, validated settings for spectrum building, scoring and search."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, fields, replace

from . import constants as C


def _number(obj, name, lo=None, hi=None, open_lo=False, integer=False, optional=False):
    value = getattr(obj, name)
    if value is None:
        if optional:
            return
        raise ValueError(f"{name} must not be None")
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} must be a single finite number")
    if lo is not None and (value < lo or (open_lo and value == lo)):
        raise ValueError(f"{name} must be {'>' if open_lo else '>='} {lo}")
    if hi is not None and value > hi:
        raise ValueError(f"{name} must be <= {hi}")
    if integer and value != int(value):
        raise ValueError(f"{name} must be a whole number")


def _flag(obj, name):
    if not isinstance(getattr(obj, name), bool):
        raise ValueError(f"{name} must be True or False")


def _choice(obj, name, choices, optional=False):
    value = getattr(obj, name)
    if value is None and optional:
        return
    if value not in choices:
        raise ValueError(f"{name} must be one of: {', '.join(map(str, choices))}")


# --- fixed values: misspelled setting -> intended setting ---
KNOWN_TYPOS = {
    "backedn": "backend",
    "binppm": "bin_ppm",
    "smearppm": "smear_ppm",
    "smear_knd": "smear_kind",
    "max_dense_cell": "max_dense_cells",
    "prefilter_topk": "prefilter_top_k",
}


@dataclass(frozen=True)
class Params:
    # quant normalisation
    normalize_ref: object = None
    normalize_cols: tuple | None = None
    # peak preprocessing
    min_mz: float = 35.0
    max_mz: float = 650.0
    centroid_ppm: float = 10.0
    noise_thr: float = 0.01
    topK: int = 200
    use_sqrt: bool = False
    # derived mass-difference spectrum
    loss_top_peaks: int = 40
    loss_max_peaks: int = 250
    loss_min: float = 5.0
    loss_max: float = 350.0
    # typical-loss projection
    use_typical_loss: bool = False
    loss_raw_beta: float = 0.80
    loss_typical_ppm: float | None = None
    loss_typical_conf_gamma: float = 1.0
    # split anchored / pairwise channels
    use_split_loss: bool = False
    loss_anchor_weight: float = 0.6
    loss_anchor_conf_gamma: float = 1.0
    # reference-mass confidence
    use_mref_confidence: bool = False
    mref_conf_nloss_ref: float = 3.0
    mref_conf_int_ref: float = 0.05
    mref_conf_hi_window: float = 50.0
    mref_conf_hi_int_ref: float = 0.03
    mref_conf_w_nloss: float = 0.4
    mref_conf_w_intensity: float = 0.4
    mref_conf_w_hi: float = 0.2
    mref_conf_power: float = 1.0
    # loss library
    use_extended_losses: bool = False
    use_derivatization_losses: bool = False
    derivatization_type: str | None = "TMS"
    derivatization_mode: str | None = None
    derivatization_auto_ppm: float | None = None
    derivatization_auto_min_int: float = 0.02
    derivatization_auto_strong_int: float = 0.08
    derivatization_typical_weight: float = 0.5
    derivatization_raw_loss_weight: float = 0.5
    derivatization_frag_weight: float = 1.0
    # distance
    distance_method: str = "wasserstein"
    wasserstein_align: bool = False
    wasserstein_transition_mult: float = 3.0
    ot_method: str = "exact"
    sinkhorn_epsilon: float = 0.05
    sinkhorn_niter: int = 100
    tol_ppm: float = 20.0
    mass_power: float = 3.0
    intensity_power: float = 0.5
    w_frag: float = 0.70
    w_loss: float = 0.30
    # retention-index handling and analog graph
    ri_mode_cluster: str = "none"
    ri_mode_analog: str = "none"
    ri_sigma: float = 30.0
    ri_window_hard: float = 100.0
    analog_k: int = 30
    analog_sim_threshold: float = 0.5
    analog_ri_gap: float = 100.0
    # execution (kept for call compatibility; Spark schedules the work)
    use_parallel: bool = False
    n_cores: int = 4
    backend: str | None = "pair_loop"
    bin_ppm: float = 2.0
    smear_ppm: float | None = None
    smear_kind: str = "tri"
    max_dense_cells: int = 10_000_000
    prefilter_method: str | None = None
    prefilter_top_k: int | None = None
    # classes and diagnostics
    class_detection_ppm: float = 15.0
    classify_rules: dict | None = None
    return_distance_components: bool = False

    def with_(self, **changes) -> "Params":
        known = {f.name for f in fields(self)}
        for name in changes:
            if name in KNOWN_TYPOS:
                raise ValueError(f"Unknown parameter '{name}'; did you mean '{KNOWN_TYPOS[name]}'?")
            if name not in known:
                raise ValueError(f"Unknown parameter '{name}'")
        return replace(self, **changes)

    def validate(self) -> "Params":
        _choice(self, "distance_method", C.DISTANCE_METHODS)
        for name in ("ri_mode_cluster", "ri_mode_analog"):
            _choice(self, name, ("none", "soft", "hard"))
        _choice(self, "ot_method", C.OT_METHODS, optional=True)
        _choice(self, "backend", ("pair_loop", "sparse_bins"), optional=True)
        _choice(self, "smear_kind", ("tri", "rect"), optional=True)
        _choice(self, "prefilter_method", C.DISTANCE_METHODS, optional=True)
        for name in ("min_mz", "max_mz", "loss_min", "loss_max", "mass_power", "intensity_power",
                     "w_frag", "w_loss", "ri_window_hard", "analog_ri_gap"):
            _number(self, name, 0)
        for name in ("centroid_ppm", "tol_ppm", "wasserstein_transition_mult", "ri_sigma",
                     "class_detection_ppm"):
            _number(self, name, 0, open_lo=True)
        for name in ("sinkhorn_epsilon", "bin_ppm", "smear_ppm", "loss_typical_ppm",
                     "derivatization_auto_ppm"):
            _number(self, name, 0, open_lo=True, optional=True)
        for name in ("noise_thr", "analog_sim_threshold"):
            _number(self, name, 0, 1)
        for name in ("loss_anchor_weight", "loss_raw_beta", "derivatization_auto_min_int",
                     "derivatization_auto_strong_int", "derivatization_typical_weight",
                     "derivatization_raw_loss_weight", "derivatization_frag_weight"):
            _number(self, name, 0, 1, optional=True)
        for name in ("topK", "loss_top_peaks", "loss_max_peaks", "analog_k", "n_cores"):
            _number(self, name, 1, integer=True)
        for name in ("sinkhorn_niter", "max_dense_cells", "prefilter_top_k"):
            _number(self, name, 1, integer=True, optional=True)
        for name in ("loss_anchor_conf_gamma", "loss_typical_conf_gamma", "mref_conf_nloss_ref",
                     "mref_conf_int_ref", "mref_conf_hi_window", "mref_conf_hi_int_ref",
                     "mref_conf_w_nloss", "mref_conf_w_intensity", "mref_conf_w_hi",
                     "mref_conf_power"):
            _number(self, name, 0, optional=True)
        for f in fields(self):
            if f.type == "bool":
                _flag(self, f.name)
        if self.max_mz <= self.min_mz:
            raise ValueError("max_mz must be greater than min_mz")
        if self.loss_max <= self.loss_min:
            raise ValueError("loss_max must be greater than loss_min")
        if self.w_frag + self.w_loss <= 0:
            raise ValueError("w_frag + w_loss must be greater than 0")
        if self.normalize_cols is not None and (
            isinstance(self.normalize_cols, str)
            or any(not isinstance(c, str) or not c for c in self.normalize_cols)
        ):
            raise ValueError("normalize_cols must be non-empty column names or None")
        if self.derivatization_type is not None and self.derivatization_type.upper() not in (
            "TMS", "TBDMS", "BOTH", "TMS+TBDMS", "TBDMS+TMS"
        ):
            raise ValueError("derivatization_type must be TMS, TBDMS or BOTH")
        if self.derivatization_mode is not None and self.derivatization_mode.lower() not in (
            "off", "manual", "auto"
        ):
            raise ValueError("derivatization_mode must be off, manual or auto")
        if self.classify_rules is not None and not isinstance(self.classify_rules, dict):
            raise ValueError("classify_rules must be a dict or None")
        weights = [w for w in (self.mref_conf_w_nloss, self.mref_conf_w_intensity,
                               self.mref_conf_w_hi) if w is not None]
        if weights and sum(weights) <= 0:
            raise ValueError("reference-mass confidence weights must sum to more than 0")
        for bad, text in (
            (self.loss_max_peaks < self.loss_top_peaks,
             "loss_max_peaks is smaller than loss_top_peaks"),
            (abs(self.w_frag + self.w_loss - 1) > 1e-6, "w_frag + w_loss is not 1"),
            (bool(weights) and abs(sum(weights) - 1) > 1e-6,
             "reference-mass confidence weights do not sum to 1; they are normalised"),
            (self.loss_typical_conf_gamma == 0, "loss_typical_conf_gamma is 0"),
            (self.derivatization_auto_strong_int < self.derivatization_auto_min_int,
             "derivatization_auto_strong_int is below derivatization_auto_min_int"),
        ):
            if bad:
                warnings.warn(text, stacklevel=2)
        return self

    # --- derived settings -------------------------------------------------
    @property
    def deriv_mode(self) -> str:
        if self.derivatization_mode is not None:
            mode = self.derivatization_mode.lower()
            return mode if mode in ("off", "manual", "auto") else "off"
        return "manual" if self.use_derivatization_losses else "off"

    @property
    def deriv_allowed(self) -> str:
        return normalize_deriv_type(self.derivatization_type)

    @property
    def diagnostic_ppm(self) -> float:
        return self.derivatization_auto_ppm or self.class_detection_ppm or self.tol_ppm

    @property
    def typical_ppm(self) -> float:
        return self.tol_ppm if self.loss_typical_ppm is None else self.loss_typical_ppm

    @property
    def base_losses(self) -> list:
        return C.CORE_LOSSES + (C.EXTENDED_LOSSES if self.use_extended_losses else [])

    def loss_universe(self) -> list:
        extra = deriv_losses(self.deriv_allowed) if self.deriv_mode in ("manual", "auto") else []
        return self.base_losses + extra


def normalize_deriv_type(value) -> str:
    """Blank means TMS; combined spellings mean BOTH."""
    if value is None or str(value) == "":
        return "TMS"
    text = str(value).upper()
    return "BOTH" if text in ("TMS+TBDMS", "TBDMS+TMS") else text


def deriv_losses(kind) -> list:
    kind = normalize_deriv_type(kind)
    table = {"TMS": C.TMS_LOSSES, "TBDMS": C.TBDMS_LOSSES, "BOTH": C.TMS_LOSSES + C.TBDMS_LOSSES}
    return table.get(kind, [])


def default_params(**changes) -> Params:
    return Params().with_(**changes).validate()


def lc_default_params(**changes) -> Params:
    base = dict(min_mz=20.0, max_mz=2000.0, topK=300, w_frag=1.0, w_loss=0.0)
    return Params().with_(**{**base, **changes}).validate()


@dataclass(frozen=True)
class LCSearchPlan:
    precursor_ppm: float | None = 10.0
    rt_window: float | None = None
    require_ion_mode: bool = True
    require_adduct: bool = False
    collision_energy_tolerance: float | None = None
    missing_metadata: str = "allow"
    exclude_same_id: bool = False
    first_pass_method: str = "entropy_weighted"
    rerank_method: str = "ppm_wasserstein"
    first_pass_top_k: int = 50
    final_top_k: int = 10

    def __post_init__(self):
        _number(self, "precursor_ppm", 0, open_lo=True, optional=True)
        _number(self, "rt_window", 0, optional=True)
        _number(self, "collision_energy_tolerance", 0, optional=True)
        for name in ("require_ion_mode", "require_adduct", "exclude_same_id"):
            _flag(self, name)
        _choice(self, "missing_metadata", ("allow", "exclude", "error"))
        _choice(self, "first_pass_method", C.DISTANCE_METHODS)
        _choice(self, "rerank_method", C.DISTANCE_METHODS)
        _number(self, "first_pass_top_k", 1, integer=True)
        _number(self, "final_top_k", 1, integer=True)
        if self.final_top_k > self.first_pass_top_k:
            raise ValueError("final_top_k must be <= first_pass_top_k")
