"""Quality scores: random Fourier features of text statistics, ridge regression, isotonic calibration.

Every whole text gives a short vector of statistics. Standardised over all training rows, it goes
through random Fourier features of a Gaussian kernel; each partition sums its part of the normal
equations, and the sums (a fixed size) are solved on the driver. Scores of a held-back part of the
training rows are counted in fixed bins and made monotone by pooling adjacent violators.

All training rows count; nothing is sampled. Defined results: a null text is an empty one and has a
score; a null label doesn't train, several labels of one id are averaged; a null id never trains and
counts as held out; without training rows every score is 0.5; repeated rows are scored each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_part, shingles, shuffle_width, slices, text_bytes, word_hashes, words_of

BINS = 1000
_KINDS = np.zeros(256, np.uint8)  # lower, upper, digit, blank, line end, symbol, bar, sentence mark, other mark, beyond ASCII, continuation
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"#*$%&<>", b"|", b".,;:?")):
    _KINDS[list(_chars)] = _k
_MARKS = [c for c in range(128) if not chr(c).isalnum() and c not in b" \t\r\x0b\x0c\n#*$%&<>|.,;:?"]
_KINDS[_MARKS] = 8
_KINDS[192:] = 9
_KINDS[128:192] = 10
N_KINDS = 11
N_STATS = N_KINDS - 1 + 9


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """N_STATS numbers per row: shares of character kinds, lengths, repetition of words, windows and lines."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row * N_KINDS + _KINDS[data], minlength=n * N_KINDS).reshape(n, N_KINDS).astype(float) if len(data) else np.zeros((n, N_KINDS))
    chars = kinds[:, :10].sum(1)
    starts, ends, of = words_of(data, offsets)
    words = np.bincount(of, minlength=n).astype(float) if len(of) else np.zeros(n)
    hashes = word_hashes(data, starts, ends)
    size = (ends - starts).astype(float)
    total, square = (np.bincount(of, weights=x, minlength=n) if len(of) else np.zeros(n) for x in (size, size ** 2))
    per = np.maximum(words, 1)
    mean = total / per
    windows, at = shingles(data, offsets, 3)
    distinct, alone, common = np.zeros(n), np.zeros(n), np.zeros(n)
    first = np.concatenate(([0], np.cumsum(words.astype(np.int64))))
    for i in range(n):
        own = hashes[first[i]:first[i + 1]]
        if len(own):
            _, counts = np.unique(own, return_counts=True)
            distinct[i] = len(counts) / np.sqrt(2 * len(own))
            common[i] = counts.max() / len(own)
            part = windows[at[i]:at[i + 1]]
            alone[i] = len(np.unique(part)) / max(1, len(part))
    ended = np.zeros(n)
    if len(of):
        last = data[ends - 1]
        ended = np.bincount(of, weights=np.isin(last, np.frombuffer(b"!#*$%&|<>", np.uint8)).astype(float), minlength=n) / per
    return np.column_stack((
        kinds[:, :10] / np.maximum(chars, 1)[:, None], np.log1p(chars), np.log1p(words), mean, np.sqrt(np.maximum(square / per - mean ** 2, 0)),
        distinct, common, alone, ended, np.log1p(kinds[:, 4]) / np.maximum(np.log1p(words), 1)))


def stats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            x = statistics(*text_bytes(b.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_STATS), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, N_STATS)


def pooled(low: np.ndarray, weight: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: centres and non-decreasing values of the blocks."""
    blocks: list[list[float]] = []
    for x, w, y in zip(low, weight, good):
        blocks.append([x * w, w, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(rows: DataFrame, *, features: int = 256, gamma: float = 0.02, ridge: float = 1e-3, seed: int = 5) -> dict | None:
    """The model; ``rows``: doc_id, x, y (0 to 1), all of them used. Every fifth id calibrates, the others fit."""
    spread = rows.select("x", "y", (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(5)) == 0).alias("held"))
    parts = cut(spread.coalesce(max(1, 2 * shuffle_width(rows.sparkSession))))
    each = [f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(N_STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    found = parts.agg(F.count("*").alias("n"), *each).first()
    if not found["n"]:
        return None
    mean = np.array([found[f"m{i}"] for i in range(N_STATS)])
    scale = np.array([found[f"s{i}"] for i in range(N_STATS)])
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(seed)
    model = {"mean": mean, "scale": scale, "w": rng.normal(0, np.sqrt(2 * gamma), (N_STATS, features)), "b": rng.uniform(0, 2 * np.pi, features)}

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for b in batches:
            z = mapped(_matrix(b.column("x")), model)
            total += z.T @ np.column_stack((z, b.column("y").to_numpy()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(features + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    # a row of the equations at a time, summed element by element over the partitions
    sums = parts.where(~F.col("held")).select("x", "y").mapInArrow(equations, "row int, sums array<double>") \
        .select("row", F.posexplode("sums").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v"))
    table = np.zeros((features + 1, features + 2))
    got = sums.toPandas()  # (features + 1) * (features + 2) numbers, whatever the corpus
    table[got["row"], got["col"]] = got["v"]
    a, y = table[:, :-1], table[:, -1]
    penalty = ridge * max(1.0, a[-1, -1]) * np.eye(features + 1)
    penalty[-1, -1] = 1e-9
    model["beta"] = np.linalg.solve(a + penalty, y)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, good = np.zeros(BINS), np.zeros(BINS)
        for b in batches:
            at = _bins(raw(_matrix(b.column("x")), model))
            n += np.bincount(at, minlength=BINS)
            good += np.bincount(at, weights=b.column("y").to_numpy(), minlength=BINS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(good[used])], ["bin", "n", "good"])

    hist = parts.where("held").select("x", "y").mapInArrow(counted, "bin int, n double, good double") \
        .groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").toPandas()
    if len(hist):
        model["at"], model["value"] = pooled((hist["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5, hist["n"].to_numpy(), hist["good"].to_numpy())
    else:
        model["at"], model["value"] = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def mapped(x: np.ndarray, model: dict) -> np.ndarray:
    """Random Fourier features and a constant."""
    z = (x - model["mean"]) / model["scale"]
    z = np.cos(np.clip(z, -8, 8) @ model["w"] + model["b"]) * np.sqrt(2 / len(model["b"]))
    return np.column_stack((z, np.ones(len(z))))


def raw(x: np.ndarray, model: dict) -> np.ndarray:
    return mapped(x, model) @ model["beta"]


def _bins(score: np.ndarray) -> np.ndarray:
    """Bins of equal width over -0.5 to 1.5; what lies beyond goes to the outer ones."""
    return np.clip(((score + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def score(rows: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score (calibrated, 0 to 1), raw (before calibration) of rows with statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.full(b.num_rows, 0.5)
            s = r
            if model is not None and b.num_rows:
                r = raw(_matrix(b.column("x")), model)
                # a touch of the raw score keeps the order inside a pooled block
                s = 0.999 * np.clip(np.interp(r, model["at"], model["value"]), 0, 1) + 0.001 * np.clip((r + 0.5) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array(r)], ["doc_id", "score", "raw"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, raw double")


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fit_args) -> DataFrame:
    """doc_id, score, raw of every row of ``docs``, learned from the rows whose id ``labels`` holds."""
    rows = cut(stats(docs, id_col=id_col, text_col=text_col))
    y = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    return score(rows, fit(rows.join(y, "doc_id"), **fit_args))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~in_part("doc_id", 4, 2))
    out = classify(docs, labels)
    return out.select("doc_id", in_part("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
