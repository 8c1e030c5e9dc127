"""Fixed domain values: mass losses, class ions and table layouts."""

# --- fixed values: neutral losses (nominal mass, exact mass, formula, class) ---
CORE_LOSSES = [
    (15, 15.0235, "CH3", "alkyl"),
    (17, 17.0027, "OH", "hydroxyl"),
    (17, 17.0265, "NH3", "amine"),
    (18, 18.0106, "H2O", "hydroxyl"),
    (28, 27.9949, "CO", "carbonyl"),
    (28, 28.0313, "C2H4", "hydrocarbon"),
    (29, 29.0027, "CHO", "aldehyde"),
    (29, 29.0391, "C2H5", "alkyl"),
    (31, 31.0184, "CH3O", "methoxy"),
    (31, 31.0422, "CH5N", "amine"),
    (32, 32.0262, "CH3OH", "methanol"),
    (42, 42.0106, "C2H2O", "ketene"),
    (42, 42.0470, "C3H6", "hydrocarbon"),
    (43, 43.0184, "CH3CO", "acetyl"),
    (43, 43.0548, "C3H7", "alkyl"),
    (44, 43.9898, "CO2", "carboxyl"),
    (44, 44.0262, "C2H4O", "acetaldehyde"),
    (45, 44.9977, "CHO2", "carboxyl"),
    (45, 45.0340, "C2H5O", "ethoxy"),
    (45, 45.0215, "CH3NO", "amide"),
    (46, 46.0055, "CH2O2", "formic_acid"),
    (46, 46.0419, "C2H6O", "ethanol"),
    (56, 55.9898, "C2O2", "dicarbonyl"),
    (56, 56.0626, "C4H8", "hydrocarbon"),
    (60, 60.0211, "C2H4O2", "acetic_acid"),
]
EXTENDED_LOSSES = [
    (16, 16.0313, "CH4", "hydrocarbon"),
    (20, 20.0062, "HF", "halogen_acid"),
    (26, 26.0157, "C2H2", "hydrocarbon"),
    (27, 27.0109, "HCN", "nitrile"),
    (28, 28.0061, "N2", "nitrogen"),
    (30, 29.9980, "NO", "nitroso"),
    (30, 30.0106, "CH2O", "aldehyde"),
    (30, 30.0470, "C2H6", "hydrocarbon"),
    (34, 33.9877, "H2S", "sulfide"),
    (36, 35.9767, "HCl", "halogen_acid"),
    (44, 44.0626, "C3H8", "hydrocarbon"),
    (46, 45.9929, "NO2", "nitro"),
    (64, 63.9619, "SO2", "sulfur_oxide"),
    (80, 79.9568, "SO3", "sulfur_oxide"),
    (80, 79.9262, "HBr", "halogen_acid"),
    (128, 127.9123, "HI", "halogen_acid"),
]
TMS_LOSSES = [
    (72, 72.0395, "C3H8Si", "deriv_TMS"),
    (73, 73.0474, "C3H9Si", "deriv_TMS"),
    (89, 89.0423, "C3H9OSi", "deriv_TMS"),
    (90, 90.0501, "C3H10OSi", "deriv_TMS"),
]
TBDMS_LOSSES = [
    (57, 57.0704, "C4H9", "deriv_TBDMS"),
    (115, 115.0943, "C6H15Si", "deriv_TBDMS"),
    (132, 132.0970, "C6H16OSi", "deriv_TBDMS"),
]

# --- fixed values: derivatization diagnostic ions (m/z) ---
TMS_IONS = (73.0474, 147.0654)
TBDMS_IONS = (115.0943, 57.0704)

# --- fixed values: siloxane background ions (m/z) ---
SILOXANE_IONS = (73.0473, 147.0654, 207.0327, 221.0848, 281.0518, 295.1075, 355.0708, 429.0884)

# --- fixed values: compound-class rule thresholds ---
CLASS_RULES = {
    "alkane_min_int": 0.05,
    "alkane_count": 4,
    "alkene_min_int": 0.05,
    "alkene_count": 3,
    "alkene_41_min_int": 0.08,
    "aromatic_77_min_int": 0.03,
    "aromatic_78_min_int": 0.05,
    "alkylbenzene_91_min_int": 0.08,
    "monoterpene_93_min_int": 0.08,
    "monoterpene_136_min_int": 0.02,
    "sesquiterpene_161_min_int": 0.03,
    "sesquiterpene_204_min_int": 0.02,
    "methyl_ketone_43_min_int": 0.20,
    "methyl_ketone_58_min_int": 0.05,
    "acetyl_43_min_int": 0.10,
    "acetyl_ratio": 1.50,
    "aldehyde_44_min_int": 0.08,
    "aldehyde_29_min_int": 0.05,
    "aldehyde_44hydro_min_int": 0.05,
    "aldehyde_44hydro_ratio": 0.50,
    "alcohol_31_min_int": 0.03,
    "alcohol_45_min_int": 0.03,
    "acetate_43_min_int": 0.15,
    "acetate_61_min_int": 0.03,
    "sulfur_47_min_int": 0.05,
    "furan_68_min_int": 0.10,
    "furan_39_min_int": 0.10,
    "furan_68hydro_min_int": 0.10,
}

# --- fixed values: feature-table metadata columns, in export order ---
FEATURE_META_COLUMNS = [
    "Alignment ID", "Average Rt(min)", "Average RI", "Quant mass",
    "Metabolite name", "Fill %", "Reference RT", "Reference RI",
    "Formula", "Ontology", "INCHIKEY", "SMILES",
    "Annotation tag (VS1.0)", "RT/RI matched", "EI-MS matched",
    "Comment", "Manually modified for quantification",
    "Manually modified for annotation", "Total score",
    "RT similarity", "RI similarity", "Total spectrum similarity",
    "Dot product", "Reverse dot product", "Fragment presence %",
    "S/N average", "Spectrum reference file name", "EI spectrum",
]
INTERNAL_COLUMNS = ["mean", "known", "compound_id", "blank_mean", "nonzero"]

# --- fixed values: MSP field synonyms -> typed library column ---
MSP_FIELDS = {
    "name": ["name", "title"],
    "cas": ["cas#", "casno", "cas"],
    "inchikey": ["inchikey"],
    "inchi": ["inchi"],
    "smiles": ["smiles"],
    "formula": ["formula", "molecular formula"],
    "mw": ["mw", "molweight", "exactmass", "precursormz"],
    "ri": ["ri", "retentionindex", "retention_index", "kovats"],
    "rt": ["rt", "retentiontime", "retention_time"],
    "num_peaks": ["num peaks", "numpeaks", "num_peaks"],
    "synonyms": ["synon"],
    "comment": ["comment", "comments"],
    "instrument": ["instrument", "instrumenttype", "instrument_type"],
    "ion_mode": ["ionmode", "ion_mode", "ionization"],
    "precursor_type": ["precursortype"],
    "collision_energy": ["collisionenergy", "collision_energy", "ce"],
    "source": ["source", "db_source"],
    "splash": ["splash"],
}

# --- fixed values: distance names ---
DISTANCE_METHODS = [
    "hellinger", "wasserstein", "ppm_wasserstein", "cosine", "entropy",
    "entropy_weighted", "entropy_unweighted", "weighted_cosine", "composite",
]
OT_METHODS = ["exact", "exact_sparse", "sinkhorn", "greenkhorn"]
OT_MARGINAL_TOLERANCE = 1e-8
NEAR_ZERO = 2.2e-16
