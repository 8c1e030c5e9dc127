"""Top-k scores of vectors with large components, against Python integers."""

import math

import numpy as np
import pytest

from peakloom.llm import topk


@pytest.mark.parametrize("size", [900.0, 1e5, 1e6, 1e7, 3e7])
def test_large_components(spark, size):
    rng = np.random.default_rng(int(size))
    rows = [(i, (rng.uniform(-1, 1, 2) * size).tolist()) for i in range(60)] + [(60, [size, 0.0]), (80, [0.0, -size]), (81, [0.25, -0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search(df, df.where("vec_id % 20 = 0"), 5, block_rows=16).collect()))
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = []
    for q in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], w)), c) for c, w in whole.items() if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)


def test_a_score_beyond_a_long_names_its_rows(spark):
    df = spark.createDataFrame([(20, [1e9, 1e9]), (7, [1e9, 1e9]), (8, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="vectors 20 and 7 does not fit a long"):
        topk.search(df, df.where("vec_id % 20 = 0"), 5).collect()
    far = spark.createDataFrame([(20, [1.0]), (9, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="vec_id 9"):
        topk.search(far, far.where("vec_id % 20 = 0"), 5).collect()


def test_opposite_terms_that_cancel(spark):
    # each product passes a long, their sum doesn't
    df = spark.createDataFrame([(20, [1e8, 1e8, 1.0]), (7, [1e9, -1e9, 3.0]), (8, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r)[2:] for r in topk.search(df, df.where("vec_id % 20 = 0"), 5).orderBy("rank").collect()]
    assert got == [(8, 2 * 64 * 64 * 10 ** 8 + 4096), (7, 3 * 4096)]
