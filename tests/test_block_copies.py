"""Cells of the block join: few copies of every row, same rows as small cells."""

import numpy as np
from conftest import make_spectra
from pyspark.sql import functions as F

from peakloom.operators import blocks, search
from peakloom.params import Params

COS = Params(distance_method="cosine")


def frame(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"s{i}", [(50 + 5 * j, float(rng.uniform(1, 9))) for j in range(6)]) for i in range(n)]
    return make_spectra(spark, rows).withColumn("frag", F.col("peaks"))


def test_rows_are_copied_to_few_cells(spark):
    s = frame(spark, 2000)
    side = 2 * int(np.ceil(np.sqrt(2 * spark.sparkContext.defaultParallelism)))
    q, lib = blocks.sides(s, s, ["frag"])
    for upper in (False, True):
        lb, rb, n = blocks.cells(q, lib, 16, upper_only=upper)
        assert lb.count() + rb.count() <= side * 2000
        assert lb.select("_cell").union(rb.select("_cell")).agg(F.max("_cell")).first()[0] < n


def test_cells_of_one_block_and_of_many_tiles_agree(spark, monkeypatch):
    s = frame(spark, 150)
    want = {(r.q_pos, r.l_pos): r.distance for r in search.pairs_within(s, COS, 0.5, fragment_only=True).collect()}
    best = {(r.q_pos, r.rank): r.l_pos for r in blocks.nearest(s, s, blocks.Scorer(COS, fragment_only=True), 4, True).collect()}
    total = {r.q_pos: r.total for r in search.row_profile(s, COS, fragment_only=True).collect()}
    monkeypatch.setattr(blocks, "BLOCK_TILES", 4)
    monkeypatch.setattr(blocks, "PENDING", 2)
    rows = search.pairs_within(s, COS, 0.5, fragment_only=True, cell=7).collect()
    assert len(rows) == len(want) == len({(r.q_pos, r.l_pos) for r in rows})
    assert {(r.q_pos, r.l_pos): r.distance for r in rows} == want
    near = blocks.nearest(s, s, blocks.Scorer(COS, fragment_only=True), 4, True, cell=7)
    assert {(r.q_pos, r.rank): r.l_pos for r in near.collect()} == best
    one = s.withColumn("band", F.lit(0))
    banded = blocks.nearest(one, one, blocks.Scorer(COS, fragment_only=True), 4, True, bucket="band", cell=7)
    assert {(r.q_pos, r.rank): r.l_pos for r in banded.collect()} == best
    got = {r.q_pos: r.total for r in search.row_profile(s, COS, fragment_only=True, cell=7).collect()}
    assert got.keys() == total.keys() and all(abs(got[k] - total[k]) < 1e-9 for k in got)


def test_keep_best_ties_and_missing_positions():
    t = blocks.to_table(blocks.HIT_SCHEMA, {"query_id": ["a", "a", "b", "a"], "q_pos": [1, 1, None, 1],
                                           "library_id": ["x", "y", "z", "w"], "l_pos": [5, 3, 1, 9], "distance": [0.5, 0.5, 0.1, 0.2]})
    got = blocks.keep_best(2)(t).to_pylist()
    assert sorted((r["query_id"], r["library_id"]) for r in got) == [("a", "w"), ("a", "y"), ("b", "z")]


def test_one_cell_for_every_core_is_enough():
    """Rows travel nl + nr times in a search of a table in itself: 7 times on 12 cores."""
    for cores, copies in ((6, 5), (8, 6), (12, 7)):
        nl, nr = blocks._block_counts(100_000, 100_000, cores, blocks.CELL)
        assert nl + nr == copies and nl * nr == cores
    for cores in (1, 2, 5, 7, 13, 36, 61):
        nl, nr = blocks._block_counts(100_000, 100_000, cores, blocks.CELL)
        n = nl * nr
        assert n >= cores and n >= 0.8 * cores * -(-n // cores) and nl * 65_536 >= 100_000 <= nr * 65_536
    nl, nr = blocks._block_counts(1_000, 60_000, 12, blocks.CELL)
    assert (nl, nr) == (1, 12)
    assert blocks._block_counts(1_000_000, 1_000_000, 12, blocks.CELL) == (16, 16)
    assert blocks._block_counts(3, 3, 12, blocks.CELL) == (1, 1) == blocks._block_counts(0, 0, 12, blocks.CELL)
    for n, cores, side in ((100_000, 12, 5), (100_000, 8, 4), (100_000, 1, 2), (20, 12, 1), (0, 4, 1)):
        assert blocks._block_counts(n, n, cores, blocks.CELL, upper_only=True) == (side, side)
