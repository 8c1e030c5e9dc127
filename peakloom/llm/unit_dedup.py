"""Duplicate removal by line, paragraph or sentence hashing.

A text is cut into units, each unit is normalised (lower case, runs of white space as one blank) and
hashed to 128 bits, digests are grouped over the corpus, the occurrence of lowest rank (doc_id, then
place) stays, and all others are removed, their original offsets kept. Units of fewer than
``min_words`` words stay: common short lines are no sign of copying. ``sentence`` cuts lines further
after sentence ends, so that passages set into the middle of a line are found too.

``whole`` also hashes the lines and paragraphs around the units, and, around every unit of too few
words, the shortest runs of neighbouring units that reach ``min_words``, one that begins and one that
ends with it; the words are counted on the larger unit. So a passage of short sentences or short lines
goes with all its units, and a short unit beside a copied one goes where the earlier text has both side
by side. Any repeated run of whole units that has ``min_words`` words in all is covered by such pieces.

Defined results: a null text stays null and an empty one empty, without units; rows equal in id and
text are one document, treated alike; null ids rank first; an empty table gives no rows; offsets are
code points, end exclusive; ``dedup`` keeps all other columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import cut, free_names, hot_join, slices, stored

CUTS = {"line": r"(?<=\n)", "paragraph": r"(?<=\n\n)", "sentence": r"(?<=\n)|(?<=[.!?] )"}


BLANKS = " \t\n\x0b\f\r"


def parts_of(text: str, pattern: re.Pattern) -> list[tuple[int, int, list[bytes]]]:
    """Start, end and words of every unit that has words; bytes split at BLANKS only, and not at other white space."""
    out, at = [], 0
    for part in pattern.split(text):
        words = part.encode().split()
        if words:
            out.append((at, at + len(part), words))
        at += len(part)
    return out


def runs(parts: list[tuple[int, int, list[bytes]]], min_words: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """For each part of fewer than ``min_words`` words, the shortest runs of parts with that many that begin and end with it."""
    for i, (_, _, words) in enumerate(parts):
        if len(words) < min_words:
            for step in (1, -1):
                n, k = len(words), i
                while n < min_words and 0 <= k + step < len(parts):
                    k += step
                    n += len(parts[k][2])
                if n >= min_words:
                    lo, hi = min(i, k), max(i, k)
                    yield parts[lo][0], parts[hi][1], [w for p in parts[lo:hi + 1] for w in p[2]]


def units(docs: DataFrame, unit: str, min_words: int, whole: bool = False) -> DataFrame:
    """id, h, start, end, d1, d2 of every unit that can be removed; ``docs``: id, h, text."""
    pattern = re.compile(CUTS[unit])
    larger = [re.compile(CUTS[c]) for c in ("line", "paragraph") if c != unit] if whole else []

    def pieces(text: str) -> Iterator[tuple[int, int, list[bytes]]]:
        fine = parts_of(text, pattern)
        yield from (p for p in fine if len(p[2]) >= min_words)
        if whole:
            yield from runs(fine, min_words)
            for wide in larger:
                yield from (p for p in parts_of(text, wide) if len(p[2]) >= min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, start, end, digests = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                seen = set()
                for at, stop, words in pieces(text or ""):
                    if whole:  # one piece of words is counted once, by whatever cuts it is found
                        place = (at + len(text[at:stop]) - len(text[at:stop].lstrip(BLANKS)), len(words))
                        if place in seen:
                            continue
                        seen.add(place)
                    row.append(i)
                    start.append(at)
                    end.append(stop)
                    digests.append(hashlib.md5(b" ".join(words).decode().lower().encode()).digest())
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(take), b.column("h").take(take), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
                 pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], ["id", "h", "start", "end", "d1", "d2"])

    return docs.select("id", "h", "text").mapInArrow(run, "id long, h long, start int, end int, d1 long, d2 long")


def again(all_units: DataFrame) -> DataFrame:
    """The units whose first half of a digest is found more than once, stored; of all others only that half travels to be counted."""
    often = cut(all_units.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1"))
    total = often.agg(F.sum("n")).first()[0] or 0
    marked = hot_join(all_units, often.withColumn("often", F.lit(True)), ["d1"], "n", total)
    return stored(marked.where("often").drop("often"))


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = 8,
            whole: bool = False) -> DataFrame:
    """id, h (text hash), removed: array<struct<start, end, kept_in>>, of every document that loses a unit.

    With ``whole``, the spans of a document may lie over each other.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    found_again = again(units(keyed, unit, min_words, whole))
    place = F.struct("id", "h", "start", "end")
    shared = cut(found_again.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    found = hot_join(found_again, shared, ["d1", "d2"], "n", total).where(F.col("first").isNotNull())
    # runs of one text may lie over each other: what overlaps its own first place is no copy of it
    same_text = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    gone = found.where(~same_text | (F.col("start") >= F.col("first.end")))
    return gone.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct(
        "start", "end", F.col("first.id").alias("kept_in")))).alias("removed"))


@F.pandas_udf(StringType())
def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Each text without its spans (start and end in turn, sorted by start; they may lie over each other)."""
    out = []
    for text, own in zip(texts, spans):
        if own is None or not len(own):
            out.append(text)
            continue
        parts, at = [], 0
        for k in range(0, len(own), 2):
            parts.append(text[at:own[k]])
            at = max(at, own[k + 1])
        out.append("".join(parts) + text[at:])
    return pd.Series(out, dtype=object)


def flat(removed: Column) -> Column:
    return F.flatten(F.transform(removed, lambda s: F.array(s["start"], s["end"])))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = 8,
          removed_col: str | None = None, whole: bool = False) -> DataFrame:
    """``docs`` with repeated units cut out of the text; ``removed_col`` names a column for their original offsets."""
    key, own, h, removed = free_names(docs, "__key", "__id", "__h", "__removed")
    gone = repeats(docs, id_col=id_col, text_col=text_col, unit=unit, min_words=min_words, whole=whole) \
        .select(F.col("id").alias(own), F.col("h").alias(h), F.col("removed").alias(removed))
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    both = keyed.join(gone, keyed[id_col].cast("long").eqNullSafe(gone[own]) & (keyed[key] == gone[h]), "left")
    new = both.withColumn(text_col, without(F.col(text_col), flat(F.col(removed))))
    return new.select(*docs.columns, *([F.col(removed).alias(removed_col)] if removed_col else []))


def op7_unit_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup(docs, removed_col="spans")
    spans = F.coalesce("spans", F.array().cast("array<struct<start: int, end: int, kept_in: long>>"))
    return out.select("doc_id", "text", F.size(spans).cast("long").alias("n_removed"),
                      F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"], s["kept_in"])), ",").alias("removed"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text,
    string_split(regexp_replace(text, '([.!?] |\n)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
u AS (SELECT k, doc_id, unnest(list_transform(range(1, len(parts) + 1), lambda i: {'i': i, 'part': parts[i],
    'start': len(array_to_string(parts[1:i - 1], ''))})) AS s FROM d),
n AS (SELECT k, doc_id, s.i AS i, s.part AS part, s.start AS start, s.start + len(s.part) AS stop,
    trim(regexp_replace(lower(s.part), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM u),
c AS (SELECT *, len(norm) > 0 AND len(string_split(norm, ' ')) >= 8 AS counts FROM n),
r AS (SELECT *, counts AND row_number() OVER (PARTITION BY counts, norm ORDER BY doc_id, start) > 1 AS gone,
    first_value(doc_id) OVER (PARTITION BY counts, norm ORDER BY doc_id, start) AS kept_in FROM c)
SELECT any_value(r.doc_id) AS doc_id, coalesce(string_agg(part, '' ORDER BY i) FILTER (NOT gone), '') AS text,
  count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(start || ':' || stop || ':' || kept_in, ',' ORDER BY i) FILTER (gone), '') AS removed
FROM r GROUP BY k
"""
