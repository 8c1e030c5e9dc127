"""Near copies are decided by id and text where an id stands for several texts."""

import corpus_pipeline


def test_two_texts_of_one_id(spark):
    a, b, c, e, f = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcef")
    rows = [(1, a), (3, a + " more"), (3, b), (4, c), (4, c), (5, e), (5, f), (9, e + " more"), (None, "no id"), (None, "no id"), (7, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (3, b), (4, c), (5, e), (5, f), (7, None), (None, "no id"), (None, "no id")], key=str)
