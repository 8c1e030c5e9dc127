"""Only units whose half digest is found again travel with their places."""

from pyspark.sql import functions as F

from peakloom.llm import unit_dedup


def docs(spark, texts):
    return spark.createDataFrame([(i, f"{t} ") for i, t in enumerate(texts)], "doc_id long, text string")


def line(k):
    return f"word number {k} of a line that has its eight words."


def test_units_found_once_stay_behind(spark):
    rows = docs(spark, [line(k % 90) for k in range(100)]).selectExpr("doc_id id", "xxhash64(text) h", "text")
    kept = unit_dedup.again(unit_dedup.units(rows, "sentence", 8))
    assert sorted(r["id"] for r in kept.collect()) == [*range(10), *range(90, 100)]


def test_equal_first_half_is_no_copy(spark, monkeypatch):
    real = unit_dedup.units
    monkeypatch.setattr(unit_dedup, "units", lambda *args: real(*args).withColumn("d1", F.lit(0).cast("long")))
    got = {r["doc_id"]: r["text"] for r in unit_dedup.dedup(docs(spark, [line(1), line(2), line(1)])).collect()}
    assert got == {0: line(1) + " ", 1: line(2) + " ", 2: ""}
