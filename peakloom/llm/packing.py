"""Packing of tokenised documents into sequences of a fixed length.

A document is cut into full pieces and one remainder. Full pieces are sequences of their own; the
remainders are packed by shortest-pack-first over their length histogram: lengths are placed
longest first, each into the pack with the most room, in bulk over packs of one pattern. The
histogram has at most ``length`` rows whatever the corpus, so this runs on the driver; the
patterns come back to the documents by rank within their length. Ranks are counted inside bounded
buckets of rows, with the bucket sizes summed before, so that no length is one task.

Defined results: a null text is an empty one and still has its end token; repeated rows are
packed each on its own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_width, slices

END = 0


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, of one byte-level BPE vocabulary.

    The ids are those of ``tokenizers`` with the vocabulary at ``path`` and ``add_special_tokens=False``:
    the content of an added token, as <|endoftext|>, is that token. ``ranks_path`` is the same vocabulary
    in rank form for ``tiktoken``, a faster library that knows no added tokens; texts that hold one, and
    those where that library gives up, go to ``tokenizers``. Without it, only ``path`` is used.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.path, self.slow, self.fast = path, None, None
        if ranks_path:
            import base64
            import json

            import tiktoken

            with open(path, encoding="utf-8") as f:
                added = [token["content"] for token in json.load(f).get("added_tokens") or ()]
            self.added = re.compile("|".join(map(re.escape, added))) if added else None

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is not None and not (self.added and self.added.search(text)):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # the library's regular expressions panic on some very long runs
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def tokenized(docs: DataFrame, tokenizer: dict, *, id_col: str = "doc_id", text_col: str = "text", length: int = 1024,
              with_ids: bool = False) -> DataFrame:
    """doc_id, doc_tokens, crcs (one per piece of ``length`` ids), and the ids themselves on request."""
    schema = "doc_id long, doc_tokens long, crcs array<long>" + (", ids binary" if with_ids else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(**tokenizer)
        end, step = np.array([END], "<u4").tobytes(), 4 * length
        for b in slices(batches, "text"):
            tokens, crcs, kept = [], [], []
            for text in b.column("text").to_pylist():
                ids = (encoder(text) if text else b"") + end
                tokens.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i:i + step]) for i in range(0, len(ids), step)])
                kept.append(ids)
            out = [b.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            names = ["doc_id", "doc_tokens", "crcs"]
            if with_ids:
                out, names = [*out, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Packing patterns and how often each is used; a pattern is ((piece length, how many), ...) in order.

    The same as placing the pieces one by one, longest first, each into the pack with the most room
    where it fits, else into a new pack; packs of one pattern are moved together.
    """
    by_room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple, n: int) -> None:
        if n:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append((pattern, n))

    def more(pattern: tuple, size: int, k: int) -> tuple:
        if pattern and pattern[-1][0] == size:
            return (*pattern[:-1], (size, pattern[-1][1] + k))
        return (*pattern, (size, k))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left and rooms and rooms[-1] >= size:
            room = rooms[-1]
            pattern, n = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop()
            used = min(n, left)
            put(room, pattern, n - used)
            put(room - size, more(pattern, size, 1), used)
            left -= used
        if left:  # each new pack takes all it can before the next one is opened
            each = length // size
            put(length - each * size, ((size, each),), left // each)
            if rest := left % each:
                put(length - rest * size, ((size, rest),), 1)
    merged: dict[tuple, int] = {}
    for room in sorted(by_room):
        for pattern, n in by_room[room]:
            merged[pattern] = merged.get(pattern, 0) + n
    return list(merged.items())


def slots_of(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(piece length, first rank, last rank + 1, pieces a pack, first sequence, offset there): where ranks of a length go."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for size, each in pattern:
            start = taken.get(size, 0)
            out.append((size, start, start + n * each, each, sequence, offset))
            taken[size] = start + n * each
            offset += size * each
        sequence += n
    return out


def pack(documents: DataFrame, *, length: int = 1024, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of documents and their places.

    ``documents``: doc_id, doc_tokens, crcs, and the columns to carry. Returns doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset (and what is carried) per piece.
    """
    spark = documents.sparkSession
    # stable row keys: the checkpoint is what every later step reads
    rows = cut(documents.withColumn("row", F.monotonically_increasing_id())
               .withColumn("rest", (F.col("doc_tokens") % length).cast("int"))
               .withColumn("full", F.floor(F.col("doc_tokens") / length).cast("long")))
    histogram = {r["rest"]: r["n"] for r in rows.groupBy("rest").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    patterns = shortest_pack_first({k: n for k, n in histogram.items() if k}, length)
    sequences = sum(n for _, n in patterns)
    # buckets of rows within one remainder: about four a shuffle partition in all
    target = max(1, math.ceil(total / (4 * shuffle_width(spark))))
    buckets = spark.createDataFrame([(k, math.ceil(n / target)) for k, n in histogram.items()], "rest int, of int")
    dealt = rows.join(F.broadcast(buckets), "rest").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.col("of")))
    sizes = dealt.groupBy("rest", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("n_full")).collect()
    ranks, fulls, before = {}, sequences, []
    for r in sorted(sizes, key=lambda r: (r["rest"], r["bucket"])):
        before.append((r["rest"], r["bucket"], ranks.get(r["rest"], 0), fulls))
        ranks[r["rest"]] = ranks.get(r["rest"], 0) + r["n"]
        fulls += r["n_full"]
    before = spark.createDataFrame(before, "rest int, bucket long, rank0 long, full0 long")
    w = Window.partitionBy("rest", "bucket").orderBy("doc_id", "row")
    ranked = dealt.withColumn("rank", F.row_number().over(w) - 1) \
        .withColumn("fulls", F.sum("full").over(w.rowsBetween(Window.unboundedPreceding, -1))) \
        .join(F.broadcast(before), ["rest", "bucket"]) \
        .withColumn("rank", F.col("rank") + F.col("rank0")) \
        .withColumn("fulls", F.coalesce("fulls", F.lit(0)) + F.col("full0"))
    # slots: at most 2 * length patterns, so a bounded table; one row a remainder, ranges in rank order
    places: dict[int, list] = {}
    for size, *slot in slots_of(patterns):
        places.setdefault(size, []).append(tuple(slot))
    slots = spark.createDataFrame(
        [(size, [s[0] for s in own], own) for size, own in places.items()] or [(-1, [0], [(0, 0, 1, 0, 0)])],
        "rest int, firsts array<long>, own array<struct<first: long, past: long, each: long, sequence: long, offset: long>>")
    at = F.expr("own[cast(size(filter(firsts, f -> f <= rank)) as int) - 1]")
    placed = ranked.join(F.broadcast(slots), "rest", "left").withColumn("slot", F.when(F.col("rest") > 0, at))
    turn = F.col("rank") - F.col("slot.first")
    own = F.struct(
        (F.col("full") * length).alias("start"), F.col("rest").cast("long").alias("length"),
        F.element_at("crcs", -1).alias("ids_crc32"),
        (F.col("slot.sequence") + F.floor(turn / F.col("slot.each"))).cast("long").alias("sequence_id"),
        (F.col("slot.offset") + turn % F.col("slot.each") * F.col("rest")).cast("long").alias("offset"))
    whole = F.transform(F.expr("if(full > 0, sequence(0L, full - 1), array())").cast("array<long>"), lambda i: F.struct(
        (i * length).alias("start"), F.lit(length).cast("long").alias("length"),
        F.get("crcs", i.cast("int")).alias("ids_crc32"),
        (F.col("fulls") + i).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    pieces = F.concat(whole, F.when(F.col("rest") > 0, F.array(own)).otherwise(F.expr("array()").cast(
        "array<struct<start: long, length: long, ids_crc32: long, sequence_id: long, offset: long>>")))
    return placed.select("doc_id", "doc_tokens", *carry, F.explode(pieces).alias("p")).select(
        "doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", *carry)


def packed_sequences(docs: DataFrame, tokenizer: dict, *, id_col: str = "doc_id", text_col: str = "text",
                     length: int = 1024) -> DataFrame:
    """sequence_id, ids array<int> (padded with -1 to ``length``), and the pieces in it: the training rows themselves."""
    pieces = pack(tokenized(docs, tokenizer, id_col=id_col, text_col=text_col, length=length, with_ids=True),
                  length=length, carry=("ids",))
    own = pieces.select("sequence_id", F.struct("offset", "doc_id", "start", "length",
                                                F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("ids")).alias("p"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for parts in b.column("pieces").to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32)
                rows.append(np.concatenate((ids, np.full(length - len(ids), -1, np.int32))))
            yield pa.RecordBatch.from_arrays(
                [b.column("sequence_id"), pa.array(rows, pa.list_(pa.int32())),
                 pa.array([[{k: p[k] for k in ("offset", "doc_id", "start", "length")} for p in parts] for parts in b.column("pieces").to_pylist()],
                          pa.list_(pa.struct([(k, pa.int64()) for k in ("offset", "doc_id", "start", "length")])))],
                ["sequence_id", "ids", "pieces"])

    # a sequence holds at most ``length`` pieces, so its list is bounded
    return own.groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("pieces")).mapInArrow(
        joined, "sequence_id long, ids array<int>, pieces array<struct<offset: long, doc_id: long, start: long, length: long>>")


def public_bpe() -> dict:
    """Where the public byte-level BPE vocabulary lies; any other one can be given by its paths."""
    import public_tokenizers as P

    return {"path": P.path("byte_bpe_50k.json"), "ranks_path": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def op3_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(tokenized(docs, public_bpe()))
