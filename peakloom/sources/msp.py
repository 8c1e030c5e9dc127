"""MSP spectral-library text: a splittable reader and a writer.

Lines are read by Spark's text source, so one huge file is many splits.  Each split
parses the records it holds whole; the pieces cut by split edges are stitched together.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import peaks as P
from ..operators.spectra import build_channels, first_per_id, spread, with_class
from ..schema import MSP_SCHEMA

FIELD_OF = {syn: col for col, syns in C.MSP_FIELDS.items() for syn in syns}
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
PEAK_PAIR = re.compile(rf"\s*\(?\s*({NUMBER})(?:\s*:\s*|\s+)({NUMBER})")
STARTS_NUMBER = re.compile(rf"\s*\(?\s*{NUMBER}")
MISSING_MARK = re.compile(r"(?i)(?:^|[\s:;,()])(?:NA|N/A|NaN|NULL|\.)(?=$|[\s:;,()])")
LETTER = re.compile("[A-Za-z]")
SEPARATORS = " \t\r\n\f\v;,)"

ISSUE = T.StructType([
    T.StructField("issue_type", T.StringType()), T.StructField("field", T.StringType()),
    T.StructField("declared_peak_count", T.IntegerType()),
    T.StructField("parsed_peak_count", T.IntegerType()), T.StructField("value", T.StringType())])
RECORD_SCHEMA = T.StructType(
    [T.StructField("pos", T.LongType())] + MSP_SCHEMA.fields
    + [T.StructField("record_issues", T.ArrayType(ISSUE))])


def parse_peak_lines(lines):
    """Peak text lines to ``"mz:int ..."`` plus line numbers of (malformed, invalid) lines.

    Number tokens are kept verbatim; free text ends a line.
    """
    out, malformed, invalid = [], [], []
    for no, line in enumerate(lines, 1):
        rest = line.lstrip(SEPARATORS)
        while rest:
            m = PEAK_PAIR.match(rest)
            if m is None:
                if STARTS_NUMBER.match(rest) or MISSING_MARK.search(rest):
                    malformed.append(no)
                break
            mz, it = float(m[1]), float(m[2])
            if math.isfinite(mz) and math.isfinite(it) and mz > 0 and it > 0:
                out.append(f"{m[1]}:{m[2]}")
            else:
                invalid.append(no)
            rest = rest[m.end():].lstrip(SEPARATORS)
            if rest and not STARTS_NUMBER.match(rest):
                break
    return " ".join(out), sorted(set(malformed)), sorted(set(invalid))


def looks_like_peaks(line: str) -> bool:
    if LETTER.search(line):
        return False
    text = line.replace("(", "").replace(")", "")
    tokens = re.split(r"[\s:,;]+", text.strip(" :,;\t"))
    try:
        return len(tokens) >= 2 and all(math.isfinite(float(t)) for t in tokens)
    except ValueError:
        return False


def _to_number(text, kind=float):
    try:
        value = float(text)
        return kind(value) if math.isfinite(value) else None
    except (TypeError, ValueError):
        return None


def parse_record(lines) -> dict:
    """One record's lines to typed fields and a list of issues."""
    rec, issues, peaks, seen, other = {}, [], [], {}, []
    in_peaks = False

    def issue(kind, field, value=None, declared=None, parsed=None):
        issues.append(dict(issue_type=kind, field=field, declared_peak_count=declared,
                           parsed_peak_count=parsed, value=value))

    for raw in lines:
        line = raw.strip()
        key, colon, value = line.partition(":")
        key, value = key.strip(), value.strip()
        col = FIELD_OF.get(key.lower()) if colon else None
        if in_peaks:
            if col == "num_peaks":
                issue("duplicate_metadata_field", "num_peaks", value)
            else:
                peaks.append(line)
        elif rec.get("name") is not None and looks_like_peaks(line):
            in_peaks = True
            peaks.append(line)
        elif colon:
            low = key.lower()
            if seen.get(low) and low != "synon":
                issue("duplicate_metadata_field", low, value)
            seen[low] = True
            if col is None:
                other.append(f"{key}={value}")
            elif col == "num_peaks":
                rec[col] = _to_number(value, int)
                in_peaks = True
            elif col in ("mw", "ri", "rt"):
                rec[col] = _to_number(value)
            elif col == "synonyms" and col in rec:
                rec[col] += "; " + value
            else:
                rec[col] = value
    if other:
        rec["other_metadata"] = "; ".join(other)
    if peaks:
        rec["spectrum"], malformed, invalid = parse_peak_lines(peaks)
        for kind, numbers in (("unpaired_or_missing_peak_value", malformed),
                              ("invalid_peak_value", invalid)):
            if numbers:
                issue(kind, "spectrum", ", ".join(map(str, numbers)))
    parsed = len(rec["spectrum"].split(" ")) if rec.get("spectrum") else 0
    if rec.get("num_peaks") is not None and rec["num_peaks"] != parsed:
        issue("declared_peak_count_mismatch", "num_peaks", None, rec["num_peaks"], parsed)
    rec["record_issues"] = issues
    return rec


def text_lines(spark: SparkSession, path) -> DataFrame:
    """value, file, block (split start) in file order inside every split."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))


# --- fixed patterns: record markers ---
NUM_PEAKS_LINE = re.compile(r"\s*Num[\s_]*Peaks\s*:", re.I)
NAME_LINE = re.compile(r"\s*(?:NAME|TITLE)\s*:", re.I)
EMBEDDED_NAME = re.compile(r"(?<=[0-9])(?:NAME|TITLE):", re.I)


class Scanner:
    """Cuts a line stream into records: a blank line, or a name line while peaks are
    pending, ends one.  A name glued to the end of a declared peak line is split off."""

    def __init__(self, named: bool = False):
        self.lines, self.named, self.peaks, self.declared, self.repairs = [], named, False, False, []

    def flush(self):
        done, self.lines = self.lines, []
        self.named = self.peaks = False
        return [done] if done else []

    def feed(self, line: str) -> list:
        if not line.strip():
            self.declared = False
            return self.flush()
        if ":" not in line:  # most lines, and no marker of any kind
            pass
        elif NUM_PEAKS_LINE.match(line):
            self.declared = True
        elif self.declared and (m := EMBEDDED_NAME.search(line)):
            self.declared = False
            head, tail = line[:m.start()], line[m.start():]
            self.repairs.append((tail.split(":", 1)[0], head, tail))
            return self._add(head) + self._add(tail)
        elif NAME_LINE.match(line):
            self.declared = False
        return self._add(line)

    def _add(self, line):
        col = FIELD_OF.get(line.partition(":")[0].strip().lower()) if ":" in line else None
        done = self.flush() if col == "name" and self.peaks else []
        self.lines.append(line)
        if col == "name" and not self.peaks:
            self.named = True
        elif col == "num_peaks":
            self.peaks = True
        elif self.named and not self.peaks and looks_like_peaks(line):
            self.peaks = True
        return done


def split_pieces(rows):
    """Pieces of consecutive splits: yields (file, block, kind, index, lines).

    ``rec`` is a record known to be whole.  A split that starts inside a file cannot
    know what came before: lines up to its first certain boundary are its ``head``, and
    its unfinished last record is its ``tail``; the two meet again in ``stitch``.
    """
    state = None
    for value, file, block in rows:
        if state is None or state[0] != (file, block):
            if state is not None:
                yield from _close(state)
            # [key, head lines, scanner or None, index of next record, first is unsure]
            state = [(file, block), [], Scanner() if block == 0 else None, 1, False]
        if state[2] is None:
            if not value.strip():
                state[1].append(value)
                state[2] = Scanner()
            elif NAME_LINE.match(value):
                state[2], state[4] = Scanner(), True
                state[2].feed(value)
            else:
                state[1].append(value)
            continue
        for done in state[2].feed(value):
            if state[4]:
                state[1] += done
                state[4] = False
            else:
                yield file, block, "rec", state[3], done
                state[3] += 1
    if state is not None:
        yield from _close(state)


def _close(state):
    (file, block), head, scanner, index, unsure = state
    rest = scanner.lines if scanner is not None else []
    if scanner is not None and unsure:
        head, rest, scanner = head + rest, [], None
    if block != 0:
        yield file, block, "head", 0, head
    if scanner is not None:
        yield file, block, "tail", index, rest


def parse_lines(lines: DataFrame) -> DataFrame:
    """Records of (value, file, block) lines; ``pos`` follows file and record order.

    One pass over the text parses whole records where their split is read and keeps the pieces cut by split edges
    beside them; only these are gathered, one pair per split.
    """
    names = [f.name for f in RECORD_SCHEMA.fields]
    schema = T.StructType([T.StructField("file", T.StringType())] + RECORD_SCHEMA.fields)
    piece = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("idx", T.LongType()),
                          T.StructField("lines", T.ArrayType(T.StringType()))] + schema.fields)

    def rows_of(frames):
        for pdf in frames:
            yield from zip(pdf["value"], pdf["file"], pdf["block"])

    def typed(records, fields=schema):
        out = pd.DataFrame(records, columns=fields.names, dtype=object)
        for c, kind in (("pos", "Int64" if fields is piece else "int64"), ("num_peaks", "Int32"), ("mw", float), ("ri", float), ("rt", float)):
            out[c] = out[c].astype(kind)
        return out

    def pieces(frames):
        buffer = []
        for file, block, kind, index, text in split_pieces(rows_of(frames)):
            if kind == "rec":
                buffer.append({**parse_record(text), "pos": block + index, "file": file, "kind": kind, "lines": None})
            else:
                buffer.append({"file": file, "block": int(block), "kind": kind, "idx": index, "lines": text, "record_issues": None})
            if len(buffer) >= 2000:
                yield typed(buffer, piece)
                buffer = []
        yield typed(buffer, piece)

    # read three times below: whole records, cut pieces, names of files (each split leaves a piece)
    parsed = lines.select("value", "file", "block").mapInPandas(pieces, piece).persist()
    cut = parsed.filter("kind <> 'rec'").select("file", "block", "kind", "idx", "lines")
    # a tail opens a group that runs to the next tail: two rows per split are ordered here
    w = Window.partitionBy("file").orderBy("block", "kind")
    group = F.sum((F.col("kind") == "tail").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    cut = (cut.withColumn("grp", group).groupBy("file", "grp")
           .agg(F.array_sort(F.collect_list(F.struct("block", "kind", "idx", "lines"))).alias("parts")))

    def stitch(frames):
        for pdf in frames:
            out = []
            for file, parts in zip(pdf["file"], pdf["parts"]):
                scanner, start = Scanner(), None
                for part in parts:
                    for line in part["lines"]:
                        for done in scanner.feed(line):
                            out.append({**parse_record(done), "pos": start, "file": file})
                            start = None
                        if start is None and line.strip():
                            start = part["block"] + part["idx"]
                out += [{**parse_record(done), "pos": start, "file": file} for done in scanner.flush()]
            yield typed(out)

    both = parsed.filter("kind = 'rec'").select(*schema.names).unionByName(cut.mapInPandas(stitch, schema))
    files = parsed.filter("kind <> 'rec'").select("file").distinct().withColumn(
        "_f", F.row_number().over(Window.orderBy("file")) - 1)  # one row per file
    return both.join(files, "file").withColumn(
        "pos", F.shiftleft(F.col("_f").cast("long"), 44) + F.col("pos")).select(*names)


def read_msp(spark: SparkSession, path, drop_empty_columns: bool = False) -> DataFrame:
    """Typed library rows (one per record) with ``pos`` and ``record_issues``."""
    out = parse_lines(text_lines(spark, path))
    return drop_all_null(out) if drop_empty_columns else out


def drop_all_null(df: DataFrame) -> DataFrame:
    """Remove library columns that hold no value at all (one aggregation)."""
    names = [f.name for f in MSP_SCHEMA.fields if f.name in df.columns]
    row = df.agg(*[F.count(c).alias(c) for c in names]).first()
    return df.drop(*[c for c in names if row[c] == 0])


def embedded_repairs(lines: DataFrame) -> DataFrame:
    """Diagnostics of glued record starts: file, block, marker, peak_prefix, record_start."""
    def run(frames):
        key, scanner = None, None
        for pdf in frames:
            out = []
            for value, file, block in zip(pdf["value"], pdf["file"], pdf["block"]):
                if key != (file, block):
                    key, scanner = (file, block), Scanner()
                scanner.feed(value)
                out += [(file, int(block), *r) for r in scanner.repairs]
                scanner.repairs = []
            yield pd.DataFrame(out, columns=["file", "block", "marker", "peak_prefix", "record_start"], dtype=object)

    return lines.select("value", "file", "block").mapInPandas(
        run, "file string, block long, marker string, peak_prefix string, record_start string")


def record_issues(library: DataFrame) -> DataFrame:
    return library.select("pos", F.col("name").alias("record_name"),
                          F.explode("record_issues").alias("i")).select("pos", "record_name", "i.*")


def peak_encoding_counts(lines: DataFrame) -> DataFrame:
    """How many peak lines use ``mz:int``, whitespace pairs, or carry annotations."""
    v = F.trim("value")
    return lines.agg(
        F.count_if(v.rlike(rf"^\(?\s*{NUMBER}\s*:\s*{NUMBER}")).alias("colon_lines"),
        F.count_if(v.rlike(rf"^\(?\s*{NUMBER}\s+{NUMBER}")).alias("whitespace_lines"),
        F.count_if(v.rlike(rf"^\(?\s*{NUMBER}(\s*:\s*|\s+){NUMBER}\s*.*[\"A-Za-z]")).alias("annotated_lines"))


def convert_library(lib: DataFrame, id_column: str = "name", require_ri: bool = False,
                    require_inchikey: bool = False) -> DataFrame:
    """Filter, keep the first row per id, drop empty spectra; known = 'T'."""
    if require_ri:
        lib = lib.filter(F.col("ri").isNotNull())
    if require_inchikey:
        lib = lib.filter(F.length("inchikey") > 0)
    meta = [c for c in ("name", "inchikey", "formula", "smiles", "comment") if c in lib.columns]
    first = first_per_id(lib.withColumn("id", F.col(id_column)), "id")
    return first.filter(F.length("spectrum") > 0).select(
        "id", "pos", F.lit("T").alias("known"), "ri",
        F.col("spectrum").alias("ei"), *meta)


def build_spectra_from_msp(spark: SparkSession, path, p, require_ri: bool = False) -> DataFrame:
    """Read, convert and build all channels; class from the comment when it has one."""
    spec = convert_library(read_msp(spark, path), require_ri=require_ri)
    parsed = spread(spec, "pos").withColumn("peaks", P.parse_peaks(F.col("ei")))
    return with_class(build_channels(parsed, p), p).drop("peaks")


def msp_text(spectra: DataFrame, peaks: str = "frag") -> DataFrame:
    """One text value per spectrum; intensities scaled to 999, empty spectra skipped."""
    def field(label, col, fmt=None):
        if col.lower() not in [c.lower() for c in spectra.columns]:
            return F.lit("")
        value = F.col(col) if fmt is None else fmt(F.col(col))
        return F.when(value.isNotNull() & (F.length(value.cast("string")) > 0),
                      F.concat(F.lit(label + ": "), value.cast("string"), F.lit("\n"))).otherwise("")

    x = F.col(peaks)
    top = F.array_max(F.transform(x, lambda q: q["intensity"]))
    body = P.let(top, lambda t: F.array_join(F.transform(x, lambda q: F.format_string(
        "%.4f %.0f", q["mz"], F.bround(q["intensity"] / t * 999, 0))), "\n"))
    parts = [
        F.concat(F.lit("NAME: "), F.col("id"), F.lit("\n")),
        field("RI", "RI", lambda c: F.bround(c, 0).cast("long")),
        field("INCHIKEY", "inchikey"), field("FORMULA", "formula"),
        field("COMMENT", "compound_class", lambda c: F.when(F.length(c) > 0, F.concat(
            F.lit("CompoundClass="), c))),
        F.concat(F.lit("Num Peaks: "), F.size(x).cast("string"), F.lit("\n")), body, F.lit("\n")]
    return spectra.filter(F.size(x) > 0).select(
        "pos", reduce(lambda a, b: F.concat(a, b), parts).alias("value"))


def write_msp(spectra: DataFrame, path: str, peaks: str = "frag", single_file: bool = False) -> None:
    """Write MSP text as a directory of part files (or one file for small exports)."""
    out = msp_text(spectra, peaks).orderBy("pos").select("value")
    (out.coalesce(1) if single_file else out).write.mode("overwrite").text(path)
