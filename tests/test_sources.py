"""MSP and feature-table parsing, writing and malformed input."""

import pytest
from pyspark.sql import functions as F

from peakloom import Params, lc_default_params
from peakloom.operators import lc, quant
from peakloom.sources import demo, msdial, msp


def write(tmp_path, text, name="x.msp"):
    f = tmp_path / name
    f.write_text(text)
    return str(f)


def records(spark, path):
    return msp.read_msp(spark, path).orderBy("pos").collect()


@pytest.mark.parametrize("lines,want,bad", [
    (["100.123456789 0.125", "2e2:3.75e-1", "300 4; 400 5", '145.10437 2983677 "a 5"'],
     "100.123456789:0.125 2e2:3.75e-1 300:4 400:5 145.10437:2983677", ([], [])),
    (["100 1 200"], "100:1", ([1], [])), (["200"], "", ([1], [])), (["100 NA"], "", ([1], [])), (["NA 1"], "", ([1], [])),
    (["100 0"], "", ([], [1])), (["(50 1) (60 2)"], "50:1 60:2", ([], []))])
def test_peak_lines(lines, want, bad):
    text, malformed, invalid = msp.parse_peak_lines(lines)
    assert text == want and (malformed, invalid) == bad


def test_blank_lines_make_no_records(spark, tmp_path):
    got = records(spark, write(tmp_path, "\n\nNAME: a\nNum Peaks: 1\n50 1\n\n\nNAME: b\nNum Peaks: 1\n60 2\n\n"))
    assert [(r["name"], r["spectrum"]) for r in got] == [("a", "50:1"), ("b", "60:2")]


def test_duplicates_are_reported(spark, tmp_path):
    text = "NAME: a\nRI: 1000\nRI: 1001\nNum Peaks: 3\nNum Peaks: 4\n50 1\n60 2\nSynon: x\n"
    r = records(spark, write(tmp_path, text))[0]
    assert (r["ri"], r["num_peaks"], r["spectrum"]) == (1001, 3, "50:1 60:2")
    assert [i["issue_type"] for i in r["record_issues"]].count("duplicate_metadata_field") == 2
    assert r["record_issues"][-1]["issue_type"] == "declared_peak_count_mismatch"


def test_fields(spark, tmp_path):
    text = ("Title: a\nCAS#: 1-2\nMW: 10\nPrecursorMZ: 321.1234\nPRECURSORTYPE: [M+H]+\nPrecursor_type: kept aside\n"
            "Synon: s1\nSynon: s2\nOdd: v:w\nMW: bad\nNum Peaks: 1\n50:1\n")
    r = records(spark, write(tmp_path, text))[0]
    assert r["cas"] == "1-2" and r["mw"] is None and r["precursor_type"] == "[M+H]+"
    assert r["synonyms"] == "s1; s2" and r["other_metadata"] == "Precursor_type=kept aside; Odd=v:w"


def test_glued_record_start(spark, tmp_path):
    path = write(tmp_path, "NAME: first\nComment: abc5NAME: no\nNum Peaks: 2\n50 1\n429.08865 1533679NAME: second\nNum Peaks: 1\n60 1\n")
    got = records(spark, path)
    assert [(r["name"], r["spectrum"]) for r in got] == [("first", "50:1 429.08865:1533679"), ("second", "60:1")]
    fixed = msp.embedded_repairs(msp.text_lines(spark, path)).collect()
    assert len(fixed) == 1 and fixed[0]["marker"] == "NAME"


def test_adjacent_records_without_separator(spark, tmp_path):
    got = records(spark, write(tmp_path, "NAME: a\n50 100\n73 200\nNAME: b\n60 120\n91 180\n"))
    assert [r["spectrum"] for r in got] == ["50:100 73:200", "60:120 91:180"]


@pytest.mark.parametrize("sep", ["\n", ""])
def test_small_splits_equal_one_split(spark, tmp_path, sep):
    """Records cut anywhere by split edges come out whole, once, in order."""
    body = "".join(f"NAME: r{i}\nRI: {i}\nNum Peaks: {1 + i % 4}\n" + "".join(f"{50 + j} {i + 1}\n" for j in range(1 + i % 4)) + sep
                   for i in range(60))
    path = write(tmp_path, body)
    whole = [(r["name"], r["spectrum"]) for r in records(spark, path)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in ("37b", "101b", "400b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = records(spark, path)
            assert [(r["name"], r["spectrum"]) for r in got] == whole and len(whole) == 60
            assert len({r["pos"] for r in got}) == 60
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_convert_filters_before_dedupe(spark, tmp_path):
    def rec(name, ri, peaks="50 1"):
        return f"NAME: {name}\n" + (f"RI: {ri}\n" if ri else "") + f"Num Peaks: 1\n{peaks}\n\n"
    path = write(tmp_path, rec("A", None) + rec("B", 1000) + rec("A", 1100, "51 1") + rec("A", 1200) + "NAME: E\nRI: 1300\nNum Peaks: 0\n\n")
    got = msp.convert_library(msp.read_msp(spark, path), require_ri=True).orderBy("pos").collect()
    assert [(r["id"], r["ri"]) for r in got] == [("B", 1000), ("A", 1100)]


def test_round_trip(spark, tmp_path):
    src = write(tmp_path, "NAME: a\nRI: 1000.4\nINCHIKEY: K\nNum Peaks: 2\n50.12345 10\n60 5\n\n")
    lib = msp.build_spectra_from_msp(spark, src, Params())
    msp.write_msp(lib, str(tmp_path / "out"), single_file=True)
    r = records(spark, str(tmp_path / "out"))[0]
    assert (r["name"], r["ri"], r["inchikey"]) == ("a", 1000, "K")
    assert r["spectrum"].startswith("50.123") and r["spectrum"].endswith(" 60.0000:500")


def test_lc_record(spark, tmp_path):
    path = write(tmp_path, "NAME: q\nPRECURSORMZ: 321.1234\nPRECURSORTYPE: [M+H]+\nIONMODE: Positive\nRETENTIONTIME: 4.2\nCE: 25 eV\nNum Peaks: 2\n100 1\n150 2\n\nNAME: q\nNum Peaks: 1\n90 1\n")
    got = lc.read_lc_msp(spark, path, lc_default_params()).orderBy("pos").collect()
    r = got[0]
    assert (r["precursor_mz"], r["ion_mode"], r["rt"], r["collision_energy"]) == (321.1234, "positive", 4.2, 25)
    assert [x["id"] for x in got] == ["q", "q__1"]


# --- feature tables -------------------------------------------------------------

META = ["Alignment ID", "Average Rt(min)", "Average RI", "Metabolite name", "Annotation tag (VS1.0)", "Total score",
        "RT similarity", "INCHIKEY", "EI spectrum"]
QUANT = ["BLK_01", "QC_01", "STD_01", "S01", "S02", "Average", "Stdev", "1", "1"]


def export(tmp_path, rows):
    pad = ["", *[""] * (len(META) - 1)]
    head = [["Class", *pad[1:], "", "Blank", "QC", "Standard", "A", "B", "", "", "", ""],
            ["File type", *pad[1:], "", "Blank", "QC", "Standard", "Sample", "Sample", "", "", "", ""],
            ["Injection order", *pad[1:], "", "1", "2", "3", "4", "5", "", "", "", ""],
            ["Batch ID", *pad[1:], "", "1", "1", "1", "1", "1", "", "", "", ""]]
    text = "\n".join("\t".join(map(str, r)) for r in head + [META + QUANT] + rows) + "\n"
    return write(tmp_path, text, "t.txt")


def row(i, name, tag, key, quant, ei="50:100 73.0474:300 147.0654:120"):
    return [i, 1.0 + i, 600 + i, name, tag, "", "", key, ei, *quant, 1, 1, 1, 1]


def test_roles_and_quant(spark, tmp_path):
    path = export(tmp_path, [row(1, "Compound_A", 1, "KEY1", [1, 10, 10, 10, 12]), row(2, "Unknown", 4, "", [0, 1, 1, 5, 5]),
                             row(3, "Compound_A", 1, "KEY1", [0, 1, 1, 2, 2]), row(4, "Compound_B", 1, "KEY2", [50, 1, 1, 3, 3]),
                             row(5, "Compound_C", "", "KEY3", [0, 1, 1, 9, 9]), row(6, "Compound_D", 1, "KEY1", [0, 1, 1, 3, 3])])
    t = msdial.read_ms_dial(spark, path)
    roles = {m["column"]: m["role"] for m in t.sample_meta}
    assert [roles[c] for c in ("BLK_01", "QC_01", "STD_01", "S01", "S02", "Average", "Stdev")] == ["blank", "qc", "standard", "sample", "sample", "summary", "summary"]
    assert all(r == "summary" for c, r in roles.items() if c.startswith("1..."))
    assert msdial.get_signal_cols(t) == ["S01", "S02"]
    q = quant.prepare_quant_data(t, Params(), blank_factor=2, nonzero_ratio=0)
    assert {r["compound_id"] for r in q.final.collect()} == {"Compound_A", "Unknown_2"}
    spec = {r["id"]: r for r in quant.build_df_spec(t, q.final).collect()}
    assert spec["Unknown_2"]["known"] == "F" and spec["Compound_A"]["ri"] == 601


def test_missing_blank_keeps_feature(spark, tmp_path):
    t = msdial.read_ms_dial(spark, export(tmp_path, [row(1, "A", 1, "K", ["", 1, 1, 10, 10]), row(2, "B", 1, "K2", ["", 1, 1, 10, ""])]))
    got = quant.prepare_quant_data(t, Params(), blank_factor=2, nonzero_ratio=0).cleaned.collect()
    assert [(r["compound_id"], r["blank_mean"], r["S01"]) for r in got] == [("A", 0, 10)]  # B: one NULL signal drops it


def test_reference_row_normalisation(spark, tmp_path):
    t = msdial.read_ms_dial(spark, export(tmp_path, [row(1, "A", 1, "K", [0, 1, 1, 10, 20]), row(2, "B", 1, "K2", [0, 1, 1, 5, 40])]))
    with pytest.warns(UserWarning):
        q = quant.prepare_quant_data(t, Params(normalize_ref="A"), nonzero_ratio=0)
    got = {r["compound_id"]: (r["S01"], r["S02"]) for r in q.final.collect()}
    assert got == {"A": (1, 1), "B": (.5, 2)}
    with pytest.raises(ValueError):
        quant.prepare_quant_data(t, Params(normalize_ref="nope"))


def test_name_fallback():
    names = ["20230208STD", "STD_01", "Stdev", "S01", "BLK1", "pooled qc", "7"]
    assert msdial.get_std_cols(names) == ["20230208STD", "STD_01"]
    assert msdial.get_sample_cols(names) == ["S01"]


def test_demo_table(spark):
    a, b = (demo.generate_demo_msdial(spark, seed=s).data.orderBy("pos") for s in (1, 1))
    assert a.collect() == b.collect() and a.count() == 10
    assert demo.generate_demo_msdial(spark, seed=2).data.orderBy("pos").collect() != a.collect()
    assert a.filter(F.col("`Annotation tag (VS1.0)`") == "4").count() == 5
