"""Helpers shared by the text operators: shared checkpoints, Arrow slices, skew-safe joins, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in HOT_SHARE; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 2000
#: No key is hot with so few rows.
FEW_ROWS = 250

_MASK = (1 << 64) - 1


def cut_folder(spark: SparkSession) -> None:
    """Set the checkpoint folder from ``spark.checkpoint.dir``, or a temporary one for a local master without it (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="run-")
        sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder of ``spark.checkpoint.dir`` and cut its lineage there."""
    cut_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table in that folder: what made it runs once, where an eager checkpoint runs it twice."""
    cut_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until ``docs`` has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_part(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; an unknown id counts as inside the part."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(True))


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], n_col: str, total: int) -> DataFrame:
    """``rows`` left join ``table`` (one row per key) where a few keys may hold most rows.

    ``n_col`` of ``table`` says how many rows share the key. Keys with more than total / HOT_SHARE
    rows, at most HOT_SHARE of them, are broadcast; all others are joined by a shuffle in which
    no key can hold more than that share; without hot keys it is a plain join. The table is read
    more than once: cut it first.
    """
    share = max(total // HOT_SHARE, FEW_ROWS)
    most = table.agg(F.max(n_col)).first()[0]
    if most is None or most <= share:
        return rows.join(table.drop(n_col), keys, "left")
    values = [c for c in table.columns if c not in (*keys, n_col)]
    hot = table.where(F.col(n_col) > share).select(*keys, F.struct(*values).alias("_hot"))
    cold = table.where(F.col(n_col) <= share).select(*keys, F.struct(*values).alias("_cold"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    # what the broadcast has answered goes on without the shuffle
    rest = marked.where("_hot is null").drop("_hot").join(cold, keys, "left").withColumnRenamed("_cold", "_found")
    done = marked.where("_hot is not null").withColumnRenamed("_hot", "_found")
    both = rest.unionByName(done)
    return both.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in values])


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``most_bytes`` of text each (one row, if it alone is longer)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after the other, and the n + 1 row offsets; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = _stream(11, 256)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BYTE[SPACE] = 0
_PLACE = _stream(23, 1 << 16) | np.uint64(1)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every run outside SPACE, and the row it belongs to."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    last = np.empty_like(inside)
    last[:-1] = inside[:-1] & (~inside[1:] | first[1:])
    last[-1] = inside[-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each word with A-Z lowered: a sum of byte keys times place keys, finalised."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + block, "right")))
        lo, hi = starts[at], ends[stop - 1]
        span = np.diff(np.append(starts[at:stop], hi))
        place = np.arange(lo, hi) - np.repeat(starts[at:stop], span)
        keys = _PLACE[place & 0xFFFF]
        if place[-1] > 0xFFFF or span.max() > 0xFFFF:
            keys = keys + (place >> 16).astype(np.uint64) * np.uint64(0xD1342543DE82EF96)
        out[at:stop] = np.add.reduceat(_BYTE[data[lo:hi]] * keys, starts[at:stop] - lo)
        at = stop
    return mixed(out + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


_STEP = _stream(37, 8) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles of all rows, in order, and n + 1 row offsets.

    A row with fewer words, but one at least, has its whole word sequence as its only shingle.
    """
    n = len(offsets) - 1
    starts, ends, row = words_of(data, offsets)
    h = word_hashes(data, starts, ends)
    count = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    first = np.concatenate(([0], np.cumsum(count)))
    sizes = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out = np.zeros(0, np.uint64)
    if len(h):
        padded = np.concatenate((h, np.zeros(width, np.uint64)))
        total = np.zeros(len(h), np.uint64)
        for k in range(width):
            total += padded[k:k + len(h)] * _STEP[k]
        place = np.arange(len(h)) - first[row]
        keep = place <= (count - width)[row]
        short = (count < width)[row]
        if short.any():
            for r in np.flatnonzero((count > 0) & (count < width)):
                own = h[first[r]:first[r + 1]]
                total[first[r]] = (own * _STEP[:len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
            keep |= short & (place == 0)
        out = mixed(total[keep])
    return out, np.concatenate(([0], np.cumsum(sizes)))
