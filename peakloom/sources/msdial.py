"""MS-DIAL feature-table export: four metadata rows, a header, tab-separated rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C

# --- fixed values: metadata row labels, in file order ---
META_ROWS = ["class", "file_type", "injection_order", "batch_id"]


def header_key(text) -> str:
    return re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", (text or "").strip().lower()))


def meta_value(text):
    text = (text or "").strip()
    return text or None


# --- fixed values: label patterns (matched on lower-case text) ---
BLANK_PATTERN = r"(blank|blk)"
QC_PATTERN = r"(quality\s*control|pooled|(^|[_ -])qc([_ -]|$)|^qc[0-9])"
STANDARD_PATTERN = r"(standard|std($|[_ -]|[0-9]))"
SUMMARY_PATTERN = r"^(average|stdev)(\.\.\.[0-9]+)?$"
REPAIRED_NUMBER_PATTERN = r"^\d+(\.\d+)?(\.\.\.[0-9]+)?$"


def _has(pattern, text) -> bool:
    return bool(re.search(pattern, (text or "").strip().lower()))


def is_blank_label(x) -> bool:
    return _has(BLANK_PATTERN, x)


def is_qc_label(x) -> bool:
    return _has(QC_PATTERN, x)


def is_standard_label(x) -> bool:
    return _has(STANDARD_PATTERN, x)


def is_repaired_numeric(x) -> bool:
    return _has(REPAIRED_NUMBER_PATTERN, x)


def is_summary_name(x) -> bool:
    return _has(SUMMARY_PATTERN, x) or is_repaired_numeric(x)


def infer_role(name, raw=None, meta=()) -> str:
    """feature_meta > summary > qc > blank > standard > sample > other.

    ``meta`` is (class, file type, injection order, batch) of the column.
    """
    meta = tuple(meta) + (None,) * (4 - len(meta))
    if name in C.FEATURE_META_COLUMNS or name in C.INTERNAL_COLUMNS:
        return "feature_meta"
    if is_summary_name(name) or is_summary_name(raw):
        return "summary"
    label = " ".join(x for x in (meta[0], meta[1], raw, name) if x)
    for role, test in (("qc", is_qc_label), ("blank", is_blank_label), ("standard", is_standard_label)):
        if test(label):
            return role
    return "sample" if any(meta) else "other"


def repair_names(names) -> list:
    """Duplicate header names become ``name...k`` (k = 1-based column position)."""
    twice = {n for n in names if names.count(n) > 1}
    return [f"{n}...{i}" if n in twice or n == "" else n for i, n in enumerate(names, 1)]


@dataclass
class FeatureTable:
    """Feature rows plus one metadata record per column."""

    data: DataFrame
    sample_meta: list
    raw_header: list
    source: str | None = None

    def columns_by_role(self, *roles) -> list:
        return [m["column"] for m in self.sample_meta if m["role"] in roles]

    def sample_meta_frame(self, spark: SparkSession) -> DataFrame:
        ddl = ("column string, column_raw string, index int, class string, file_type string, "
               "injection_order string, batch_id string, role string")
        return spark.createDataFrame([tuple(m[k] for k in (
            "column", "column_raw", "index", "class", "file_type", "injection_order", "batch_id",
            "role")) for m in self.sample_meta], ddl)


def build_sample_meta(columns, raw_names, preview, skip: int) -> list:
    """Match the metadata rows to columns; a leading label column shifts them right."""
    rows = preview[:skip]
    width = max([len(r) for r in rows], default=0)
    shift = max(0, width - len(columns))
    found = {}
    for r in rows:
        for cell in r:
            key = header_key(cell)
            if key:
                if key in META_ROWS and key not in found:
                    found[key] = r
                break
    for i, key in enumerate(META_ROWS):
        if key not in found and i < len(rows):
            found[key] = rows[i]
    out = []
    for i, (name, raw) in enumerate(zip(columns, raw_names)):
        rec = dict(column=name, column_raw=raw, index=i + 1)
        for key in META_ROWS:
            row = found.get(key, [])
            value = meta_value(row[i + shift]) if i + shift < len(row) else None
            rec[key] = value if name not in C.FEATURE_META_COLUMNS else None
        rec["role"] = infer_role(name, raw, tuple(rec[k] for k in META_ROWS))
        out.append(rec)
    return out


def read_ms_dial(spark: SparkSession, path: str, skip: int = 4) -> FeatureTable:
    """Header lines are looked up on the driver; body rows stay a Spark scan."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"))
    head = [r["value"].rstrip("\r").split("\t") for r in lines.filter("block = 0").orderBy("n").limit(skip + 1).collect()]
    raw = head[skip]
    names = repair_names(raw)
    body = lines.filter(~((F.col("block") == 0) & F.col("n").isin(list(range(skip + 1)))))
    body = body.filter(F.length(F.trim("value")) > 0)
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    numeric = {"Average Rt(min)", "Average RI", "Quant mass", "Fill %", "Reference RI", "Total score",
               "RT similarity", "RI similarity", "Total spectrum similarity", "Dot product",
               "Reverse dot product", "Fragment presence %", "S/N average"}
    meta = build_sample_meta(names, raw, head[:skip], skip)
    number = numeric | {m["column"] for m in meta if m["role"] != "feature_meta"}
    # one file: Spark lays its splits out in file order, so n is the line order
    cols = [F.col("n").alias("pos")]
    for i, name in enumerate(names):
        cell = F.nullif(F.trim(F.get(cells, F.lit(i))), F.lit(""))
        cell = cell.try_cast("double") if name in number else cell
        cols.append(cell.alias(name))
    data = body.select(*cols)
    return FeatureTable(data, meta, head, path)


def as_feature_table(data, sample_meta=None) -> FeatureTable:
    return data if isinstance(data, FeatureTable) else FeatureTable(data, sample_meta or [], [])


def _names(t) -> list:
    if isinstance(t, (list, tuple)):
        return list(t)
    return [c for c in as_feature_table(t).data.columns if c != "pos"]


def get_cols_by_role(t, *roles) -> list:
    if isinstance(t, (list, tuple)):
        return []
    return as_feature_table(t).columns_by_role(*roles)


def get_blank_cols(t) -> list:
    return get_cols_by_role(t, "blank") or [c for c in _names(t) if is_blank_label(c)]


def get_qc_cols(t) -> list:
    return get_cols_by_role(t, "qc") or [c for c in _names(t) if is_qc_label(c)]


def get_std_cols(t) -> list:
    return get_cols_by_role(t, "standard") or [c for c in _names(t) if is_standard_label(c)]


def get_sample_cols(t) -> list:
    """Header roles when known, else every column that is nothing else by name."""
    known = get_cols_by_role(t, "sample")
    if known:
        return known
    taken = set(C.FEATURE_META_COLUMNS) | set(C.INTERNAL_COLUMNS)
    return [c for c in _names(t) if c not in taken and not (
        is_summary_name(c) or is_blank_label(c) or is_qc_label(c) or is_standard_label(c))]


def _ordered(t, wanted) -> list:
    return [c for c in _names(t) if c in set(wanted)]


def get_quant_cols(t, include_qc=True, include_blank=True, include_std=True) -> list:
    wanted = list(get_sample_cols(t))
    for on, pick in ((include_qc, get_qc_cols), (include_blank, get_blank_cols), (include_std, get_std_cols)):
        wanted += pick(t) if on else []
    return _ordered(t, wanted)


def get_signal_cols(t, include_qc=False) -> list:
    return _ordered(t, get_sample_cols(t) + (get_qc_cols(t) if include_qc else []))
