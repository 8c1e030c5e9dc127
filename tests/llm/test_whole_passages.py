"""Passages of short sentences or short lines go whole; what overlaps itself or only looks alike stays."""

import corpus_pipeline
from peakloom.llm import unit_dedup

DDL = "doc_id long, text string"
SHORT = " ".join(f"Word{i} of part{i}." for i in range(25))


def left(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), DDL)
    return {r["doc_id"]: r["text"] for r in unit_dedup.dedup(docs, whole=True, **more).collect()}


def test_short_sentences_and_lines(spark):
    lines = SHORT.replace(". ", ".\n")
    texts = [f"An own beginning. {SHORT} An own end.", f"Other words before. {SHORT} Other words behind.",
             f"x\n{lines}\ny", f"z\n{lines}\nq", "keep this\nkeep that", "keep this\nand other"]
    out = left(spark, texts)
    assert out[0] == texts[0] and out[1] == "Other words before. Other words behind."
    assert out[2] == "x\ny" and out[3] == "z\nq" and out[4] == texts[4] and out[5] == texts[5]


def test_short_unit_between_copies_and_rewrapped_paragraph(spark):
    a, b = "one two three four five six seven eight nine.", "ten eleven twelve thirteen fourteen fifteen sixteen seventeen."
    texts = [f"{a} Short one. {b}", f"{a} Other one. {b}", f"Mine. {a} Short one. {b}", "p q r s t\nu v w x y\n\nend", "p q r\ns t u v w x y\n\nend"]
    out = left(spark, texts)
    assert out[0] == texts[0] and out[1] == "Other one. " and out[2] == "Mine. " and out[3] == texts[3] and out[4] == "\nend"


def test_periodic_text_keeps_its_first_place(spark):
    text = "la la.\n" * 6
    assert left(spark, [text, "own\n" + text]) == {0: text, 1: "own\n"}


def test_pipeline_stage(spark):
    docs = spark.createDataFrame([(0, f"Own. {SHORT} A."), (1, f"Its. {SHORT} B.")], DDL)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.passages(spark, docs, "").collect()}
    assert out == {0: f"Own. {SHORT} A.", 1: "Its. B."}
