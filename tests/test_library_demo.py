"""End-to-end goldens: seven spectra as MSP text through search."""

import pytest

from peakloom import Params
from peakloom.plans.pipeline import library_run
from peakloom.operators import benchmark
from peakloom.sources.msp import build_spectra_from_msp

LIBRARY = [
    ("LIB_A", 1000, "AAAAAAAAAAAAAA-TESTAA", "C6H6", "50 300,77 999,91 799,105 350"),
    ("LIB_B", 1120, "BBBBBBBBBBBBBB-TESTBB", "C7H8", "55 280,79 999,93 759,107 320"),
    ("LIB_C", 1260, "CCCCCCCCCCCCCC-TESTCC", "C8H10O", "60 250,88 999,103 739,121 400"),
    ("LIB_D", 1390, "DDDDDDDDDDDDDD-TESTDD", "C5H10O2", "43 420,61 999,74 659,87 360"),
]
QUERIES = [
    ("Q_A", 1005, "AAAAAAAAAAAAAA-QUERY1", "C6H6", "50 330,77 999,91 769,105 310"),
    ("Q_B", 1115, "BBBBBBBBBBBBBB-QUERY2", "C7H8", "55 300,79 999,93 729,107 290"),
    ("Q_C", 1268, "CCCCCCCCCCCCCC-QUERY3", "C8H10O", "60 270,88 999,103 699,121 380"),
]
GOLDEN = {
    "cosine": [("LIB_A", .9990445872761828), ("LIB_B", .16099429352763683), ("LIB_C", .007806913646700608),
               ("LIB_B", .9993797687002551), ("LIB_A", .16106460493889163), ("LIB_C", .007621824230454766),
               ("LIB_C", .9993490094791772), ("LIB_D", .01626412536492894), ("LIB_A", .009455059546695677)],
    "weighted_cosine": [("LIB_A", .9997252394590065), ("LIB_B", .012066058143406555), ("LIB_C", .0016547085516429583),
                        ("LIB_B", .9998339655566217), ("LIB_A", .012183731726675084), ("LIB_C", .001967444042655808),
                        ("LIB_C", .999937620223737), ("LIB_B", .002124197671121708), ("LIB_A", .0018200686772987806)],
    "composite": [("LIB_A", .9607455020416198), ("LIB_B", .09090307221076532), ("LIB_C", .0016547085516429583),
                  ("LIB_B", .969934793854677), ("LIB_A", .08605481956997985), ("LIB_C", .001967444042655808),
                  ("LIB_C", .9774199334654751), ("LIB_B", .002124197671121708), ("LIB_A", .0018200686772987806)],
}


def msp(rows):
    out = []
    for name, ri, key, formula, peaks in rows:
        p = peaks.split(",")
        out.append("\n".join([f"NAME: {name}", f"RI: {ri}", f"INCHIKEY: {key}", f"FORMULA: {formula}",
                              f"Num Peaks: {len(p)}", *p, ""]))
    return "\n".join(out)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("demo")
    (d / "q.msp").write_text(msp(QUERIES))
    (d / "l.msp").write_text(msp(LIBRARY))
    return str(d / "q.msp"), str(d / "l.msp")


@pytest.mark.parametrize("method", list(GOLDEN))
def test_hits_match_goldens(spark, files, method):
    got = library_run(spark, *files, Params(distance_method=method), top_n=3).orderBy("query_id", "rank").collect()
    assert [r["query_id"] for r in got] == ["Q_A"] * 3 + ["Q_B"] * 3 + ["Q_C"] * 3
    for row, (lib, sim) in zip(got, GOLDEN[method]):
        assert row["library_id"] == lib
        assert row["similarity"] == pytest.approx(sim, abs=1e-9)
    assert got[0]["delta_ri"] == 5 and got[0]["formula"] == "C6H6" and got[0]["ri"] == 1000


def test_retrieval_summary(spark, files):
    q, lib = (build_spectra_from_msp(spark, f, Params()) for f in files)
    out = benchmark.benchmark_library_search(q, lib, Params(), ["cosine"], top_n=3)["summary"].first()
    assert (out["map"], out["mrr"], out["p_at_1"], out["p_at_5"], out["n_queries"]) == (1, 1, 1, .25, 3)


def test_ri_window_keeps_only_close_entries(spark, files):
    got = library_run(spark, *files, Params(distance_method="cosine"), 3, ri_tolerance=10).collect()
    assert {(r["query_id"], r["library_id"]) for r in got} == {("Q_A", "LIB_A"), ("Q_B", "LIB_B"), ("Q_C", "LIB_C")}
