"""Leaked values that a few sources quote, and short assigned ones, are masked; widely copied ones are not."""

import corpus_pipeline
from peakloom.llm import secret_scan


def test_secrets_of_few_sources_and_short_values(spark):
    key, wide = "0123456789abcdef" * 2 + "89abcdef", "fedcba9876543210" * 2 + "01234567"
    key = key.replace("0123456789", "9f1e3d5b7a")
    rows = [(i, f"token: {key}" if i < 3 else f"token: {wide}", f"s{i}") for i in range(12)]
    rows += [(20, "password: abc123", "s0"), (21, "password: xxxxxx and token = ......", "s1"), (22, "passwd=hunter2", None)]
    docs = spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets(spark, docs, "").collect()}
    assert all(out[i] == "[assign]" for i in (0, 1, 2, 20, 22))
    assert all(wide in out[i] for i in range(3, 12)) and out[21] == rows[-2][1]


def test_bound_follows_the_corpus(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "cast(id as string) as source")
    assert secret_scan.owners_of_live(docs) == 20 and secret_scan.owners_of_live(docs.limit(0)) == secret_scan.SEVERAL
