"""The text of a library is read once, with records cut by split edges among the whole ones."""

from peakloom.sources.msp import parse_lines

SCHEMA = "value string, file string, block long"


def test_text_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)
    record = ["NAME: {}", "RI: 100", "Num Peaks: 2", "50.1 10", "60 (3)", ""]
    text = [line.format(f"s{i}") for i in range(6) for line in record]
    # the second split of file a begins inside a record, file b is one split
    rows = [(x, "a", 0 if i < 15 else 1000) for i, x in enumerate(text)] + [(line.format("t0"), "b", 0) for line in record]

    def count(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    lines = spark.createDataFrame(rows, SCHEMA).coalesce(1).mapInPandas(count, SCHEMA)
    got = parse_lines(lines).orderBy("pos").collect()
    assert [r["name"] for r in got] == [f"s{i}" for i in range(6)] + ["t0"]
    assert all(r["num_peaks"] == 2 and r["ri"] == 100 and r["spectrum"].startswith("50.1:10") for r in got)
    assert len({r["pos"] for r in got}) == 7
    assert seen.value == len(rows)
