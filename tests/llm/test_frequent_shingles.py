"""Shared passages stay out of the prefixes of the Jaccard join even where the sketches can't tell rare shingles from frequent ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import jaccard


@pytest.fixture
def saturated(spark):
    """Levels of counters that are all alike, as in a large corpus."""
    return spark.sparkContext.broadcast(np.zeros((2, jaccard.SKETCH), np.uint8))


def make(spark, n=40, own=100, shared=60):
    words = lambda tag, k: " ".join(f"{tag}{i}" for i in range(k))
    return spark.createDataFrame([(i, f"{words(f'own{i}_', own)} {words('same', shared)}") for i in range(n)], "doc_id long, text string")


def test_no_frequent_shingle_in_a_prefix(spark, saturated):
    docs = make(spark)
    last = spark.sparkContext.broadcast(jaccard.frequent(docs, saturated, 5, 75, 100, 4, jaccard.FEW))
    found = jaccard.candidates(jaccard.entries(docs, saturated, last, 5, 75, 100, 4), jaccard.FEW)
    assert found.count() == 0
    none = spark.sparkContext.broadcast(np.zeros(1 << 20, np.uint8))  # the order of the sketches alone
    assert jaccard.candidates(jaccard.entries(docs, saturated, none, 5, 75, 100, 4), jaccard.FEW).where("kind = 1").count() > 100


def test_only_wanted_texts_are_cut_into_sets(spark):
    docs = make(spark).unionByName(make(spark, 2))  # two texts come twice
    rows, _ = jaccard.classes(docs, 5)
    wanted = rows.where("doc_id < 5").select("c")
    sets = {r["c"]: len(r["own"]) // 8 for r in jaccard.sets_for(docs, rows, wanted, 5).collect()}
    assert sets == {r["c"]: r["n"] for r in rows.where("doc_id < 5").collect()}


def test_frequent_shingles_still_link(spark):
    near = make(spark, 30, own=10, shared=200)  # all of them are near copies
    found = jaccard.link(near.unionByName(make(spark, 30).withColumn("doc_id", F.col("doc_id") + 100)))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {**{i: 0 for i in range(30)}, **{i: i for i in range(100, 130)}}
