"""Units: fixed white space, and columns of the input that bear this module's own names."""

from peakloom.llm import unit_dedup


def test_other_white_space_cuts_no_words(spark):
    seven = "one two three four five six\u00a0and seven. "  # seven words, one of them with a no-break space
    docs = spark.createDataFrame([(1, seven), (2, seven), (3, seven + "eight nine ten eleven twelve words are here. "),
                                  (4, "eight nine ten eleven twelve words are here. ")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in unit_dedup.dedup(docs).collect()}
    assert got == {1: seven, 2: seven, 3: seven + "eight nine ten eleven twelve words are here. ", 4: ""}


def test_own_columns_stay(spark):
    text = "a sentence of more than eight words stands here. "
    docs = spark.createDataFrame([(1, text, 5, 6, 7, "x"), (2, text, 8, 9, 10, "y")], "doc_id long, text string, __key long, __h long, __id long, __removed string")
    got = sorted(map(tuple, unit_dedup.dedup(docs).collect()))
    assert got == [(1, text, 5, 6, 7, "x"), (2, "", 8, 9, 10, "y")]
