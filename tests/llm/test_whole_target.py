"""The target counts cover all trusted documents, however many there are and however they are joined."""

from peakloom.llm import quality_rules


def test_all_trusted_documents_count(spark):
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} common words") for i in range(60)] + [(None, "w1 no id")] * 3, "doc_id long, text string")

    def weights(n):
        return quality_rules.fit(docs, spark.range(n).selectExpr("id as doc_id"), buckets=256, prior=5.0).first()["weights"]

    want = weights(60)
    assert weights(60_000) == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert weights(60_000) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
