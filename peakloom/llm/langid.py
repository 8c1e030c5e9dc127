"""Language identification by nearest centroid over normalised TF-IDF character n-grams.

Fit: labelled texts, at most about ``per_lang`` of each language (chosen by a hash of the id, the
documented bound of the sample), become L2-normalised TF-IDF vectors over hashed 1-, 2- and
3-grams of letters; spherical k-means gives ``clusters`` centroids a language, one language per
task. Each language's rejection distance is the ``reject_quantile`` of the distances of its own
sample to its nearest own centroid, times ``reject_slack``.
Predict: every whole text, in Arrow batches, against all centroids by cosine.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; an
empty training table makes every text ``und``; a null language never trains; a null id never
trains and counts as held out; equal cosines go to the language first in order; repeated rows
each get their own result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_part

UNKNOWN = "und"
DIMS = 4096
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_SHIFT = np.uint32(20)  # the upper 12 bits
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])
    return _LETTER


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of a whole text, runs of other characters as one blank; None without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.ones(len(code), bool)
    low = code < 0x10000
    letter[low] = _letters()[code[low]]
    for i in np.flatnonzero(~low):
        letter[i] = chr(code[i]).isalpha()
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.where(letter, code, np.uint32(32))[keep]
    code = np.concatenate((np.array([32], np.uint32), code, np.array([32], np.uint32)))
    one, two, three = code * _A, code * _B, code * _C
    out = np.bincount((one ^ np.uint32(0x5BD1E995)) * _C >> _SHIFT, minlength=DIMS)
    out += np.bincount((one[:-1] + two[1:]) * _C >> _SHIFT, minlength=DIMS)
    if len(code) > 2:
        out += np.bincount((one[:-2] + two[1:-1] ^ three[2:]) * _A >> _SHIFT, minlength=DIMS)
    return out


def _weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def _kmeans(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; the start is the farthest-first choice from the first row."""
    centres = [rows[0]]
    near = rows @ rows[0]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[int(near.argmin())])
        near = np.maximum(near, rows @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        own = (rows @ c.T).argmax(1)
        new = np.array([rows[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_lang: int = 1000, clusters: int = 4, rounds: int = 12, reject_quantile: float = 0.99,
        reject_slack: float = 1.5) -> dict:
    """Centroids, their languages, IDF weights and rejection distances, from a bounded sample."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = (F.lit(float(per_lang)) / F.col("n") * (1 << 31)).cast("long")
    most = cut(counts.select("lang", share.alias("most")))
    # a row a language: broadcast after a look at its size, so that no text travels by its language
    sample = rows.join(F.broadcast(most) if most.count() <= 10_000 else most, "lang") \
        .where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(7)), F.lit(1 << 31)) < F.col("most"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, found = [], []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if (c := ngram_counts(text)) is not None:
                    langs.append(lang)
                    found.append(np.minimum(c, 65535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "counts"])

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.stack([np.frombuffer(x, "<u2") for x in sorted(pdf["counts"])])
        df = (counts > 0).sum(0)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "n": [len(counts)], "df": [df.astype("<i8").tobytes()]})

    taken = sample.select("lang", "text").mapInArrow(vectors, "lang string, counts binary").persist()
    stats = taken.groupBy("lang").applyInPandas(centroids, "lang string, n long, df binary").collect()
    if not stats:
        taken.unpersist()
        return {"langs": [], "idf": np.zeros(DIMS, np.float32), "centroids": np.zeros((0, DIMS), np.float32), "far": []}
    # every language weighs the same in the document frequencies, however many texts it has
    share = sum(np.frombuffer(s["df"], "<i8") / s["n"] for s in stats) / len(stats)
    idf = np.log(1.0 + 1.0 / (share + 1e-3)).astype(np.float32)

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        v = _weights(np.stack([np.frombuffer(x, "<u2") for x in sorted(pdf["counts"])]), idf)
        c = _kmeans(v, clusters, rounds)
        far = float(np.quantile(1 - (v @ c.T).max(1), reject_quantile)) * reject_slack
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "c": [c.astype("<f4").tobytes()], "far": [far]})

    found = sorted(taken.groupBy("lang").applyInPandas(grouped, "lang string, c binary, far double").collect())
    taken.unpersist()
    blocks = [np.frombuffer(r["c"], "<f4").reshape(-1, DIMS) for r in found]
    return {"langs": [r["lang"] for r, b in zip(found, blocks) for _ in b], "idf": idf,
            "centroids": np.concatenate(blocks), "far": [r["far"] for r, b in zip(found, blocks) for _ in b]}


def predict(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, nearest (language or ``und``), score (cosine), distance, rejected, lang (``und`` where rejected)."""
    langs, idf, cents, far = model["langs"], model["idf"], model["centroids"].T.copy(), model["far"]
    schema = "doc_id long, nearest string, score double, distance double, rejected boolean, lang string"

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                names, scores = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
                limit = np.full(b.num_rows, -1.0)
                counts, rows = [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    c = ngram_counts(text) if text and langs else None
                    if c is not None:
                        counts.append(c)
                        rows.append(i)
                if rows:
                    cos = _weights(np.array(counts), idf) @ cents
                    best = cos.argmax(1)
                    scores[rows] = np.clip(cos[np.arange(len(rows)), best], 0, 1)
                    for i, j in zip(rows, best):
                        names[i], limit[i] = langs[j], far[j]
                out = 1 - scores > limit
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(names), pa.array(scores), pa.array(1 - scores), pa.array(out),
                     pa.array([UNKNOWN if r else x for r, x in zip(out, names)])],
                    ["doc_id", "nearest", "score", "distance", "rejected", "lang"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(answer, schema)


def identify(docs: DataFrame, train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **fit_args) -> DataFrame:
    """Fit on ``train`` and predict every row of ``docs``."""
    return predict(docs, fit(train, id_col=id_col, text_col=text_col, **fit_args), id_col=id_col, text_col=text_col)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs.drop("lang"), docs.where(~in_part("doc_id", 3, 1)).select("doc_id", "text", "lang"))
    return out.select("doc_id", in_part("doc_id", 3, 1).alias("held_out"), F.col("nearest").alias("lang_pred"), "score",
                      "rejected")
