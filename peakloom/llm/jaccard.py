"""Exact set-similarity join of documents on word shingles, by prefixes under several global orders.

A document's set is its distinct shingles. Two documents link when their Jaccard similarity reaches
``num`` / ``den``. Steps, each over all documents:

1. sets: every text gives its set size and a 128-bit digest; documents of equal sets are one class,
   and the class is what is compared. The same pass adds up bounded sketches of how many documents
   hold a shingle, so that global orders can put rare shingles first. A counter stands for many shingles
   of a large corpus; so a second pass counts, shingle by shingle, those in the first half of each text under
   the order so far, and the first order puts the frequent ones among them last.
2. prefixes: a linked pair shares a shingle among the first n - ceil(t n) + 1 of both sets, under any
   global order. Under the first order the prefixes are dealt out by shingle and classes that share one,
   with sizes within the bound, become candidates. A shingle of many classes gives a star around its
   smallest class instead of all pairs.
3. filters and verification: the distance of two parity sketches, made in step 1, bounds the true distance
   from below and rules out most candidates before any set travels. What is left must share a prefix shingle
   under each further order too and is then verified by exact set overlap.
4. components: after the stars have joined what belongs together, the classes of frequent shingles that
   are still in different components meet as well, so no link is lost. Classes tied by such shingles form
   a team, a team is cut into blocks of bounded size, and each two blocks meet in one cell: first the
   sketches, which tell the classes that may have a partner outside their component, then the sets of
   these classes. A cell emits such classes, or links that join components, never its pairs.

Sets are made anew from the text where they are needed, so none are kept on disk; a bounded bitmap of text
hashes tells which texts that are.

Defined results: a null text, or one without words, has an empty set and links with nothing; fewer
words than the width are one shingle; repeated rows are one class; a null id keeps a component only
through others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, mixed, shingles, shuffle_width, slices, stored, text_bytes
from .graph import components

SKETCH = 1 << 20  #: counters a sketch; bounded whatever the corpus
CHUNK = 1 << 14
ORDERS = 3
FEW = 4  #: classes that share a shingle are paired directly up to this number, by stars and cells beyond
_ENTRY = np.dtype([("t", "<u4"), ("c", "<i8"), ("s", "u1")])


def sets_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of a batch of texts."""
    hashes, offsets = shingles(*text_bytes(batch.column("text")), width)
    for i in range(batch.num_rows):
        own = hashes[offsets[i]:offsets[i + 1]]
        yield i, np.unique(own) if len(own) else own


def digest(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set; the first one names its class."""
    n = np.uint64(len(own))
    with np.errstate(over="ignore"):
        a = mixed(own ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64) + n
        b = mixed(own ^ np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64) ^ (n << np.uint64(32))
    return int(mixed(np.array([a]))[0].astype(np.int64)), int(mixed(np.array([b]))[0].astype(np.int64))


def _slot(own: np.ndarray, order: int) -> np.ndarray:
    """Which counter of an order's sketch a shingle belongs to."""
    return ((own >> np.uint64(1 + 20 * (order % 2))) & np.uint64(SKETCH - 1)).astype(np.int64)


def keys(own: np.ndarray, levels: np.ndarray, order: int, last: np.ndarray | None = None) -> np.ndarray:
    """Place of each shingle in a global order: rare levels first, then by a hash of that order; those marked in ``last`` after all others."""
    tie = own if order == 0 else mixed(own + np.uint64(0x9E3779B97F4A7C15 * order & (1 << 64) - 1))
    level = levels[order % 2][_slot(own, order)].astype(np.uint64)
    if last is not None:
        level = np.minimum(level, np.uint64(127)) | last.astype(np.uint64) << np.uint64(7)
    return (level << np.uint64(56)) | (tie >> np.uint64(8))


def prefix(own: np.ndarray, levels: np.ndarray, order: int, num: int, den: int, last: np.ndarray | None = None, times: int = 1) -> np.ndarray:
    """The shingles before the bound of the prefix filter, or before ``times`` that bound."""
    size = times * (len(own) - -(-len(own) * num // den) + 1)
    if size >= len(own):
        return own
    return own[np.argpartition(keys(own, levels, order, last), size - 1)[:size]]


def _summed(chunks: DataFrame, finish) -> DataFrame:
    """chunk, counts: packed counters added up chunk by chunk, as a stream, then made small by ``finish``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
                part = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.uint64)
                sums[k] = sums[k] + part if k in sums else part
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([finish(v).tobytes()])], ["chunk", "counts"])

    return chunks.repartition(min(2 * SKETCH // CHUNK, 4 * shuffle_width(chunks.sparkSession)), "chunk").mapInArrow(add, "chunk int, counts binary")


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(4 * np.log2(counts + 1.0)), 255).astype(np.uint8)


def _present(counts: np.ndarray) -> np.ndarray:
    return np.packbits(counts > 0)


def sketch(own: np.ndarray) -> np.ndarray:
    """Bytes that tell, for 4 to 8 bits a shingle, whether an odd number of shingles falls on a bit. Two sketches differ in no more bits than the sets in shingles."""
    bits = 1 << max(6, math.ceil(math.log2(4 * len(own))))
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(data: np.ndarray, size: int) -> np.ndarray:
    """The same set's sketch of ``size`` bytes, as 64-bit numbers."""
    return np.bitwise_xor.reduce(data.reshape(-1, size), 0).view(np.uint64)


def classes(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, h, n, c, c2, sketch) of every row, h a hash of its text, and the level of each sketch counter for two orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((2, SKETCH), np.uint32)
        names = ["doc_id", "h", "n", "c", "c2", "sketch", "chunk", "counts"]
        for b in slices(batches, "text"):
            n, one, two, odd, seen = [], [], [], [], []
            for _, own in sets_of(b, width):
                n.append(len(own))
                a, c = digest(own) if len(own) else (None, None)
                one.append(a)
                two.append(c)
                odd.append(sketch(own).tobytes() if len(own) else None)
                seen.append(own)
            every = np.concatenate(seen)
            for order in range(2):
                counters[order] += np.bincount(_slot(every, order), minlength=SKETCH).astype(np.uint32)
            none = [None] * b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(odd, pa.binary()),
                 pa.array(none, pa.int32()), pa.array(none, pa.binary())], names)
        parts = counters.reshape(-1, CHUNK)
        used = [int(i) for i in np.flatnonzero(parts.any(1))]
        none = pa.array([None] * len(used), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, none, pa.array([None] * len(used), pa.binary()), pa.array(used, pa.int32()), pa.array([zlib.compress(parts[i].astype("<u4").tobytes(), 1) for i in used], pa.binary())], names)

    both = stored(docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, n long, c long, c2 long, sketch binary, chunk int, counts binary"))
    levels = np.zeros((2, SKETCH), np.uint8)
    for r in _summed(both.where("chunk is not null").select("chunk", "counts"), _level).collect():  # 2 * SKETCH bytes
        levels.reshape(-1, CHUNK)[r["chunk"]] = np.frombuffer(r["counts"], np.uint8)
    return both.where("chunk is null").select("doc_id", "h", "n", "c", "c2", "sketch"), levels


def _size_step(n: int, num: int, den: int) -> int:
    """Sizes on a scale where a linked pair lies at most one step of log(den / num) apart, in quarters."""
    return min(255, int(4 * math.log(n) / math.log(den / num))) if n else 0


def _dealt(names: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
    """bucket, packed: the items of ``packed`` together by the bucket of their names."""
    bucket = names >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    bucket, packed = bucket[order], packed[order]
    own, starts = np.unique(bucket, return_index=True)
    ends = np.append(starts[1:], len(bucket))
    return pa.RecordBatch.from_arrays(
        [pa.array(own.astype(np.int64)), pa.array([packed[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], ["bucket", "packed"])


def _names(own: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each shingle in the upper half, its name there in the lower."""
    h = mixed(own)
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def frequent(docs: DataFrame, levels, width: int, num: int, den: int, buckets: int, few: int) -> np.ndarray:
    """A bounded bitmap of the names of shingles that more than ``few`` texts hold before twice the bound of the prefix filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = levels.value, set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held))
            return _dealt(every, every.astype("<u4"))

        for whole in batches:
            own = whole.column("h").to_numpy().tolist()
            new = []
            for h in own:  # copies within the task: once is enough
                new.append(h not in seen)
                if len(seen) < 200_000:
                    seen.add(h)
            for b in slices([whole.filter(pa.array(new, pa.bool_()))], "text"):
                for _, own in sets_of(b, width):
                    if len(own):
                        held.append(_names(prefix(own, table, 0, num, den, times=2), buckets))
                        size += len(held[-1])
                        if size > 2_000_000:
                            yield flush()
                            held, size = [], 0
        if held:
            yield flush()

    def count(parts: list[bytes], bucket: int) -> pa.RecordBatch:
        names, n = np.unique(np.concatenate([np.frombuffer(p, "<u4") for p in parts]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names[n > few].astype(np.int64) + (bucket << 32))], ["x"])

    dealt = docs.select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, "bucket long, packed binary")
    found = stored(_by_bucket(dealt, count, "x long"))
    return _bitmap(found, "x", _bits(found.count()))


def entries(docs: DataFrame, levels, last, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """bucket, packed: the prefix shingles of all classes under the first order, dealt out by shingle; ``last``: the map of ``frequent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits, seen = levels.value, last.value, set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held)
            packed = np.empty(len(every), _ENTRY)
            packed["t"], packed["c"], packed["s"] = every["h"].astype(np.uint32), every["c"], every["s"]
            return _dealt(every["h"], packed)

        for b in slices(batches, "text"):
            for _, own in sets_of(b, width):
                if not len(own):
                    continue
                c = digest(own)[0]
                if c in seen:  # copies within the task: once is enough
                    continue
                if len(seen) < 200_000:
                    seen.add(c)
                chosen = prefix(own, table, 0, num, den, _held(bits, _names(own, buckets)))
                part = np.empty(len(chosen), [("h", "<u8"), ("c", "<i8"), ("s", "u1")])
                part["h"], part["c"], part["s"] = _names(chosen, buckets), c, _size_step(len(own), num, den)
                held.append(part)
                size += len(part)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket long, packed binary")


def _expand(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j inside consecutive groups."""
    first = np.repeat(starts, sizes)
    place = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i = first + place
    after = np.repeat(sizes, sizes) - place - 1
    left = np.repeat(i, after)
    step = np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after) + 1
    return left, left + step


def candidates(dealt: DataFrame, few: int, step: int = 4) -> DataFrame:
    """kind 0: a pair a < b; kind 2: such a pair of a star; kind 1: class b holds the frequent shingle a. Every bucket once."""

    def meet(parts: list[bytes], bucket: int) -> pa.RecordBatch:
        e = np.unique(np.concatenate([np.frombuffer(p, _ENTRY) for p in parts]))  # by shingle, then class
        new = np.append(True, e["t"][1:] != e["t"][:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(e)))
        small = (sizes > 1) & (sizes <= few)
        i, j = _expand(starts[small], sizes[small])
        large = sizes > few
        if large.any():  # stars around the smallest class of similar size: the first of each size step, and the overall first
            rows = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[large], sizes[large])])
            centre = np.repeat(starts[large], sizes[large])
            by = np.lexsort((e["c"][rows], e["s"][rows] // 2, centre))
            lead = np.append(True, (centre[by][1:] != centre[by][:-1]) | (e["s"][rows[by]][1:] // 2 != e["s"][rows[by]][:-1] // 2))
            hub = rows[by][np.maximum.accumulate(np.where(lead, np.arange(len(by)), 0))]
        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            a, b = e["c"][i], e["c"][j]
            own = (np.abs(e["s"][i].astype(np.int16) - e["s"][j]) <= step + 1) & (a != b)
            return np.unique(np.stack((np.minimum(a, b)[own], np.maximum(a, b)[own]), 1), axis=0) if own.any() else np.zeros((0, 2), np.int64)

        pairs = near(i, j)
        stars = near(np.concatenate((centre, hub)), np.concatenate((rows, rows[by]))) if large.any() else pairs[:0]
        often = np.zeros((0, 2), np.int64)
        if large.any():
            name = e["t"][rows].astype(np.int64) + (np.int64(bucket) << np.int64(32))
            often = np.stack((name, e["c"][rows]), 1)
        kinds = np.repeat(np.array([0, 1, 2], np.int8), [len(pairs), len(often), len(stars)])
        both = np.concatenate((pairs, often, stars))
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["kind", "a", "b"])

    return _by_bucket(dealt, meet, "kind byte, a long, b long")


def _by_bucket(dealt: DataFrame, meet, schema: str) -> DataFrame:
    """``meet(parts, bucket)`` of what each bucket of ``dealt`` (bucket, packed) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                for bucket, packed in zip(b.column("bucket").to_pylist(), b.column("packed").to_pylist()):
                    if bucket != current and parts:
                        yield meet(parts, current)
                        parts = []
                    current = bucket
                    parts.append(packed)
        if parts:
            yield meet(parts, current)

    width = shuffle_width(dealt.sparkSession)
    return dealt.repartition(4 * width, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _bits(n: int) -> int:
    """Bits of a map of n values: 16 or more a value, 1 to 8 MB."""
    return 1 << min(26, max(23, (16 * n).bit_length()))


def _held(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a map of ``_bitmap`` holds."""
    at = (mixed(values.astype(np.uint64)) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _bitmap(rows: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """A bounded bitmap of the values of a column, for leaving out most rows without any; it may let others pass."""
    size = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for b in batches:
            seen[mixed(b.column("x").to_numpy().astype(np.uint64)) & np.uint64(bits - 1)] = True
        parts = seen.reshape(64, size)
        used = [int(i) for i in np.flatnonzero(parts.any(1))]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(parts[i].astype("<u4").tobytes(), 1) for i in used], pa.binary())],
                                         ["chunk", "counts"])

    # few tasks, so the partial maps stay few; what is added is counters, so a stream sums them
    parts = rows.select(F.col(column).alias("x")).coalesce(max(1, shuffle_width(rows.sparkSession) // 4)).mapInArrow(run, "chunk int, counts binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in _summed(parts, _present).collect():  # bits / 8 bytes
        out[r["chunk"] * size // 8:(r["chunk"] + 1) * size // 8] = np.frombuffer(r["counts"], np.uint8)
    return out


def sketches_for(rows: DataFrame, names: DataFrame) -> DataFrame:
    """c, n, sketch: of the classes in column c of ``names`` (and of a few more), each once, dealt out by class."""
    spark = rows.sparkSession
    wanted = spark.sparkContext.broadcast(_bitmap(names, "c"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        seen: set[int] = set()
        for b in batches:
            own = b.column("c").to_numpy()
            keep = _held(bits, own)
            for i in np.flatnonzero(keep):
                keep[i] = int(own[i]) not in seen
                if len(seen) < 200_000:
                    seen.add(int(own[i]))
            yield b.filter(pa.array(keep))

    return rows.where("n > 0").select("c", "n", "sketch").mapInArrow(load, "c long, n long, sketch binary") \
        .repartition(shuffle_width(spark), "c").dropDuplicates(["c"])


def near_pairs(rows: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs a, b that sizes and sketches don't rule out."""
    sketches = sketches_for(rows, pairs.select(F.explode(F.array("a", "b")).alias("c")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            sizes = b.column("n").to_numpy(), b.column("m").to_numpy()
            total = sizes[0] + sizes[1]
            able = den * np.minimum(*sizes) >= num * np.maximum(*sizes)
            for i in np.flatnonzero(able):
                x, y = (np.frombuffer(b.column(k)[int(i)].as_buffer(), np.uint8) for k in ("x", "y"))
                least = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, least) ^ folded(y, least)).sum(dtype=np.int64))
                good[i] = apart * (den + num) <= int(total[i]) * (den - num)
            yield b.select(["a", "b"]).filter(pa.array(good))

    first = pairs.join(sketches.select(F.col("c").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")
    both = first.join(sketches.select(F.col("c").alias("a"), "n", F.col("sketch").alias("x")), "a")
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(check, "a long, b long")


def sets_for(docs: DataFrame, rows: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """c, own: the sets of the classes in column c of ``names`` (and of a few more), each once, dealt out by class."""
    spark = docs.sparkSession
    # one text stands for a class; only texts whose hash is wanted are cut into shingles
    firsts = stored(rows.where("n > 0").groupBy("c").agg(F.min("h").alias("h")).join(names.select("c").distinct(), "c", "left_semi"))
    wanted = spark.sparkContext.broadcast(_bitmap(firsts, "h", _bits(firsts.count())))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        seen: set[int] = set()
        for whole in batches:
            for b in slices([whole.filter(pa.array(_held(bits, whole.column("h").to_numpy())))], "text"):
                names, found = [], []
                for _, own in sets_of(b, width):
                    if len(own):
                        c = digest(own)[0]
                        if c not in seen:
                            if len(seen) < 200_000:
                                seen.add(c)
                            names.append(c)
                            found.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.binary())], ["c", "own"])

    return docs.select(F.xxhash64("text").alias("h"), "text").mapInArrow(load, "c long, own binary") \
        .repartition(shuffle_width(spark), "c").dropDuplicates(["c"])


def _similar(left: np.ndarray, right: np.ndarray, num: int, den: int) -> bool:
    common = len(left) + len(right) - len(np.union1d(left, right))
    return den * common >= num * (len(left) + len(right) - common)


def verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, levels, width: int, num: int, den: int) -> DataFrame:
    """The pairs a, b of classes that pass the further orders and then the exact similarity."""
    # one copy of a class is enough, and all are equal; one shuffle by class serves both joins
    sets = sets_for(docs, rows, pairs.select(F.explode(F.array("a", "b")).alias("c")), width)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        last: tuple[int | None, np.ndarray, list] = (None, np.zeros(0, np.uint64), [])
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                good = np.zeros(b.num_rows, bool)
                for i, (a, x, y) in enumerate(zip(b.column("a").to_pylist(), b.column("x"), b.column("y"))):
                    if a != last[0]:
                        left = np.frombuffer(x.as_buffer(), "<u8")
                        last = (a, left, [prefix(left, table, k, num, den) for k in range(1, ORDERS)])
                    left, right = last[1], np.frombuffer(y.as_buffer(), "<u8")
                    small, big = sorted((len(left), len(right)))
                    if den * small < num * big:
                        continue
                    # a pair above the threshold shares a prefix shingle under every order
                    if all(np.isin(p, prefix(right, table, k, num, den)).any() for k, p in enumerate(last[2], 1)):
                        good[i] = _similar(left, right, num, den)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good))

    # the side that stands for fewer pairs travels with the other: pairs are dealt by b, then by a
    first = pairs.join(sets.select(F.col("c").alias("b"), F.col("own").alias("y")), "b")
    both = first.join(sets.select(F.col("c").alias("a"), F.col("own").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _parity(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of ``bits`` a set: whether an odd number of its shingles falls on a bit. Two rows differ in no more bits than the sets in shingles."""
    out = np.empty((len(sets), bits // 64), np.uint64)
    step = max(1, (1 << 22) // bits)
    for at in range(0, len(sets), step):
        part = sets[at:at + step]
        place = np.concatenate([(own & np.uint64(bits - 1)).astype(np.int64) + k * bits for k, own in enumerate(part)])
        odd = np.bincount(place, minlength=len(part) * bits) & 1
        out[at:at + step] = np.packbits(odd.astype(np.uint8)).view(np.uint64).reshape(len(part), -1)
    return out


def cell_links(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray, levels: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join groups, as index pairs: between two sides, or all inside one where ``side`` is constant.

    Every pair of different groups either is linked through what is returned, or has been found
    too far apart: by size, by parity sketch, by a prefix under one of the orders, or exactly.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets, label, side = [sets[i] for i in order], np.unique(group[order], return_inverse=True)[1], side[order]
    size = np.array([len(x) for x in sets])
    scale = np.maximum(6, np.ceil(np.log2(4 * size)).astype(int))  # log2 of the bits for rows of this size
    across = len(np.unique(side)) > 1
    prefixes: dict[int, list[np.ndarray]] = {}
    out = []

    def chosen(i: int) -> list[np.ndarray]:
        if i not in prefixes:
            prefixes[i] = [prefix(sets[i], levels, k, num, den) for k in range(ORDERS)]
        return prefixes[i]

    for bits in np.unique(scale):
        rows = np.flatnonzero(scale == bits)
        first = int(np.searchsorted(size, -(-size[rows[0]] * num // den)))
        sketch = _parity(sets[first:rows[-1] + 1], 1 << int(bits))
        for i in rows:
            low = max(first, int(np.searchsorted(size, -(-size[i] * num // den))))
            other = np.arange(low, i)
            other = other[(label[low:i] != label[i]) & ((side[low:i] != side[i]) | (not across))]
            if not len(other):
                continue
            apart = np.bitwise_count(sketch[other - first] ^ sketch[i - first]).sum(1, dtype=np.int64)
            near = apart * (den + num) <= (size[other] + size[i]) * (den - num)
            for j in other[near][np.argsort(apart[near], kind="stable")]:
                if label[j] != label[i] and all(np.isin(p, q).any() for p, q in zip(chosen(i), chosen(j))) and _similar(sets[i], sets[j], num, den):
                    out.append((int(order[i]), int(order[j])))
                    label[label == label[j]] = label[i]
    return out


def cell_near(sketches: list[np.ndarray], size: np.ndarray, group: np.ndarray, side: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether a class may be linked with one of another group: between two sides, or inside one where ``side`` is constant."""
    order = np.argsort(size, kind="stable")
    size, label, side = size[order], group[order], side[order]
    wide = np.array([len(sketches[i]) for i in order])
    across = len(np.unique(side)) > 1
    out = np.zeros(len(order), bool)
    for least in np.unique(wide):  # the wider sketch of a pair is folded to the narrower one
        rows = np.flatnonzero(wide == least)
        last = int(np.searchsorted(size, size[rows[-1]] * den // num, "right"))
        odd = np.stack([folded(sketches[order[k]], int(least)) for k in range(rows[0], last)])
        for i in rows:
            high = int(np.searchsorted(size, size[i] * den // num, "right"))
            other = np.arange(i + 1, high)
            other = other[(label[i + 1:high] != label[i]) & ((side[i + 1:high] != side[i]) | (not across))]
            if not len(other):
                continue
            apart = np.bitwise_count(odd[other - rows[0]] ^ odd[i - rows[0]]).sum(1, dtype=np.int64)
            near = other[apart * (den + num) <= (size[other] + size[i]) * (den - num)]
            if len(near):
                out[i] = True
                out[near] = True
    found = np.zeros(len(order), bool)
    found[order] = out
    return found


def _placed(dealt: DataFrame, block: int) -> DataFrame:
    """c, g, team, side and the cell i, j of each class and block that it meets; a block holds ``block`` shingles on average."""
    sums = stored(dealt.groupBy("team").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"), F.count("*").alias("n_rows")))
    return hot_join(dealt.select("c", "g", "team"), sums, ["team"], "n_rows", dealt.count()) \
        .withColumn("side", F.expr("cast(pmod(xxhash64(c), blocks) as int)")) \
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))) \
        .select("c", "g", "team", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))


def meetings(docs: DataFrame, rows: DataFrame, members: DataFrame, levels, width: int, num: int, den: int,
             block: int = 500_000, wide_block: int = 2_000_000) -> DataFrame:
    """a, b: links that join the components of ``members`` (token, c, g: class c of component g holds that shingle).

    Classes tied by shared shingles are a team. ``block`` shingles (``wide_block`` while sketches stand for them), on
    average, are a block of a team; two blocks are a cell.
    """
    teams = components(members.select(F.col("token").alias("a"), F.col("c").alias("b")))
    weights = rows.where("n > 0").select("c", "n").distinct()
    dealt = stored(members.select("c", "g").distinct().join(weights, "c")
                .join(teams.select(F.col("node").alias("c"), F.col("component").alias("team")), "c"))

    def flag(cell: pa.Table) -> pa.Table:
        sketches = [np.frombuffer(x.as_buffer(), np.uint8) for x in cell.column("sketch")]
        near = cell_near(sketches, cell.column("n").to_numpy(), cell.column("g").to_numpy(), cell.column("side").to_numpy(), num, den)
        return cell.select(["c"]).filter(pa.array(near))

    able = stored(_placed(dealt, wide_block).join(sketches_for(rows, dealt.select("c")), "c").groupBy("team", "i", "j")
                  .applyInArrow(flag, "c long").distinct())
    dealt = stored(dealt.join(able, "c"))

    def meet(cell: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in cell.column("own")]
        names = cell.column("c").to_numpy()
        links = cell_links(sets, cell.column("g").to_numpy(), cell.column("side").to_numpy(), levels.value, num, den)
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": names[ends[:, 0]], "b": names[ends[:, 1]]})

    sets = sets_for(docs, rows, dealt.select("c"), width)
    return _placed(dealt, block).join(sets, "c").groupBy("team", "i", "j").applyInArrow(meet, "a long, b long")


def _checked(edges: DataFrame) -> DataFrame:
    """Verify now, with few pairs of sets in a batch on the way to Python."""
    conf, name = edges.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "256")
    try:
        return stored(edges)
    finally:
        conf.set(name, before)


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100,
         few: int = FEW) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, counts = classes(texts, width)
    levels = spark.sparkContext.broadcast(counts)
    total = rows.agg(F.sum("n"), F.count("*")).first()
    buckets = max(4 * shuffle_width(spark), (total[0] or 0) // 1_000_000)
    last = spark.sparkContext.broadcast(frequent(texts, levels, width, num, den, buckets, FEW))
    found = stored(candidates(entries(texts, levels, last, width, num, den, buckets), few))
    # of its star pairs a class keeps the two of lowest hubs, by two orders; the rounds below miss none of the others
    stars = found.where("kind = 2").groupBy("b").agg(F.min("a").alias("a1"), F.min_by("a", F.xxhash64("a")).alias("a2")) \
        .select("b", F.explode(F.array_distinct(F.array("a1", "a2"))).alias("a"))
    pairs = stored(found.where("kind = 0").select("a", "b").unionByName(stars).distinct())
    pairs = _checked(near_pairs(rows, pairs, num, den))
    edges = _checked(verified(texts, rows, pairs, levels, width, num, den))
    groups = stored(components(edges))
    often = found.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("c"))
    # frequent shingles whose classes aren't in one component yet
    held = stored(often.join(groups.select(F.col("node").alias("c"), "component"), "c", "left") \
        .select("token", "c", F.coalesce("component", "c").alias("g")))
    split = stored(held.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("n_classes")).where("lo <> hi").select("token", "n_classes", "lo"))
    open_ = stored(hot_join(held, split, ["token"], "n_classes", held.count()).where("lo is not null"))
    if not open_.isEmpty():
        edges = edges.unionByName(_checked(meetings(texts, rows, open_.select("token", "c", "g"), levels, width, num, den)))
        groups = stored(components(edges))
    members = rows.where("n > 0").groupBy("c", "c2").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_docs"))
    named = members.join(groups.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("g", F.coalesce("component", "c"))
    lows = named.groupBy("g").agg(F.min("low").alias("component_id"), F.sum("n_docs").alias("in_all"))
    # classes of one document without links need no answer: it is its own component
    answers = stored(named.join(lows, "g").where("in_all > 1").select("c", "c2", "component_id", "n_docs"))
    out = hot_join(rows, answers, ["c", "c2"], "n_docs", total[1])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def component_sql(table: str = "documents") -> str:
    return rf"""
  w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table}),
  g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
  e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM g),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.t = y.t AND x.doc_id <> y.doc_id
        GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
  r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)"""


OP9_SQL = f"""
WITH RECURSIVE {component_sql()}
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, m.component_id
FROM g JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON g.doc_id = m.a
"""
