"""Exact top-k search by distributed histogram selection.

Vectors are packed, inside their partitions, into blocks of bounded size. Every query block meets
every candidate block through a join on a shard number (the query set is stated, so this is the
work asked for), and each meeting gives one small result per query, never its pairs. Passes:

1. score everything and count scores in coarse bins, from the top down to the k-th of the block;
   the summed histograms locate the bin that holds each query's k-th score;
2. refine that bin until it is one score wide;
3. score once more, keep what is above the k-th score, and of the scores equal to it the smallest
   ids that can still be needed; rank these few rows.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no
part, nor do rows without id; a component or a score beyond 2^63 - 2 is an error that names its row;
only vectors of one dimension are compared; a row whose id equals the query's is its own; each query
row has its own result, each repeated candidate row counts; fewer than k candidates are all returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_width

BINS = 256
#: Scores lie within this, and one value above it stays free.
MOST = 2 ** 63 - 2
BLOCK = "block long, dim int, rows int, most double, ids binary, ints binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, factor: float) -> DataFrame:
    """id and floor(factor * component) of every vector that takes part."""
    raw, own = F.col(vector_col), F.col(id_col)
    fine = F.forall(raw, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(math.inf)))
    large = F.exists(raw, lambda v: F.abs(v.cast("double") * factor) >= float(MOST))
    x = F.transform(raw, lambda v: F.floor(v.cast("double") * factor))
    told = F.raise_error(F.concat(F.lit(f"a component does not fit a long: {id_col} "), own.cast("string"))).cast("array<long>")
    return vectors.where(own.isNotNull() & raw.isNotNull() & (F.size(raw) > 0)).where(fine) \
        .select(own.cast("long").alias("id"), F.when(large, told).otherwise(x.cast("array<long>")).alias("v"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v) packed into blocks of at most ``size`` rows of one dimension, inside each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 33
        open_: dict[int, list] = {}

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal serial
            ids = np.concatenate([i for i, _ in open_[dim]])
            ints = np.concatenate([v for _, v in open_.pop(dim)])
            serial += 1
            most = float(np.sqrt((ints.astype(np.float64) ** 2).sum(1).max()))
            return pa.RecordBatch.from_arrays(
                [pa.array([serial - 1]), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([most]),
                 pa.array([ids.astype("<i8").tobytes()]), pa.array([ints.astype("<i8" if most > 2e9 else "<i4").tobytes()])],
                ["block", "dim", "rows", "most", "ids", "ints"])

        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                ids = b.column("id").to_numpy()
                v = b.column("v")
                dims = np.diff(v.offsets.to_numpy())
                flat = v.flatten().to_numpy()
                ends = np.cumsum(dims)
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    mat = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                    if sum(len(i) for i, _ in open_.get(dim, [])) + len(own) > size:
                        yield flush(dim)
                    open_.setdefault(dim, []).append((ids[own], mat))
        for dim in list(open_):
            yield flush(dim)

    return rows.mapInArrow(run, BLOCK)


def _scores(q: dict, c: dict) -> np.ndarray:
    """Integer inner products; by floating point only where every partial sum is exact."""
    def matrix(x):
        wide = "<i8" if len(x["ints"]) == 8 * x["rows"] * x["dim"] else "<i4"
        return np.frombuffer(x["ints"], wide).reshape(x["rows"], x["dim"])
    bound = q["most"] * c["most"]
    kind = np.float32 if bound < 2 ** 23 else np.float64 if bound < 2 ** 52 else np.int64
    a, b = matrix(q).astype(kind), matrix(c).astype(kind)
    s = (a @ b.T).astype(np.int64)
    if bound >= 2 ** 62:
        # sums wrap round, so they are exact wherever the true score fits; those near the end are added up as whole numbers
        near = np.abs(a.astype(np.float64) @ b.astype(np.float64).T) + bound * len(a[0]) * 2.0 ** -50 >= 2.0 ** 63
        for i, j in zip(*np.nonzero(near & (q["ids"][:, None] != c["ids"][None, :]))):
            score = sum(x * y for x, y in zip(a[i].tolist(), b[j].tolist()))
            if abs(score) > MOST:
                raise OverflowError(f"the score of vectors {q['ids'][i]} and {c['ids'][j]} does not fit a long")
    return s


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict, np.ndarray]]:
    """Every row is a query block and a candidate block; candidates with the query's id get a score below all."""
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            q = {k[2:]: v for k, v in row.items() if k.startswith("q_")}
            c = {k[2:]: v for k, v in row.items() if k.startswith("c_")}
            q["ids"], c["ids"] = np.frombuffer(q["ids"], "<i8"), np.frombuffer(c["ids"], "<i8")
            own = np.flatnonzero(np.isin(q["ids"], c["ids"]))
            order = np.argsort(c["ids"], kind="stable")
            sorted_ids = c["ids"][order]
            for at in range(0, len(q["ids"]), 256):  # bounded score tiles
                part = slice(at, at + 256)
                tile = dict(q, ids=q["ids"][part], rows=len(q["ids"][part]),
                            ints=q["ints"][at * (len(q["ints"]) // q["rows"]):(at + 256) * (len(q["ints"]) // q["rows"])])
                s = _scores(tile, c)
                for j in own[(own >= at) & (own < at + 256)]:
                    lo, hi = np.searchsorted(sorted_ids, q["ids"][j], "left"), np.searchsorted(sorted_ids, q["ids"][j], "right")
                    s[j - at, order[lo:hi]] = np.iinfo(np.int64).min
                yield dict(tile, first=at), c, s


def search(vectors: DataFrame, query_rows: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding",
           factor: float = 64.0, block_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query row, ties to the smaller id."""
    spark = vectors.sparkSession
    cands = cut(blocks(quantised(vectors, id_col, vector_col, factor), block_rows))
    asks = cut(blocks(quantised(query_rows, id_col, vector_col, factor), block_rows))
    found = cands.agg(F.count("*"), F.max("most")).first()
    n_blocks, longest = found[0], found[1] or 0.0
    shards = max(1, min(n_blocks, 2 * shuffle_width(spark)))
    left = asks.select(*[F.col(c).alias(f"q_{c}") for c in asks.columns]) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = cands.select(*[F.col(c).alias(f"c_{c}") for c in cands.columns]) \
        .withColumn("shard", F.pmod(F.xxhash64("c_block"), F.lit(shards)).cast("int"))

    def meet(q: DataFrame) -> DataFrame:
        both = q.hint("merge").join(right, (q["shard"] == right["shard"]) & (q["q_dim"] == right["c_dim"]))
        return both.drop("shard")

    # the k-th score of each query lies in [low, low + span); above: how many are over that range
    asked = asks.agg(F.max("most")).first()[0] or 0.0
    reach = min(math.ceil(asked * longest) + 1, MOST)
    width = max(1, math.ceil((2 * reach + 1) / BINS))
    span = BINS * width
    state = None  # per query block: arrays low, above

    def counted(width: int, span: int, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for q, c, s in _meetings(batches):
                n = len(q["ids"])
                at = slice(q["first"], q["first"] + n)
                low = np.full(n, -reach) if first else np.array(q["low"][at])
                # the distance may pass the end of a signed long
                over_low = s.view(np.uint64) - low.astype(np.int64).view(np.uint64)[:, None]
                # candidates over the range are counted already; under it they can't matter
                outside = (s < low[:, None]) | (over_low >= np.uint64(min(span, 2 ** 64 - 1)))
                bins = np.where(outside, -1, (over_low // np.uint64(width)).astype(np.int64))
                rows = np.repeat(np.arange(n), s.shape[1])
                hit = bins.ravel() >= 0
                hist = np.bincount(rows[hit] * BINS + bins.ravel()[hit], minlength=n * BINS).reshape(n, BINS)
                over = hist[:, ::-1].cumsum(1)[:, ::-1] - hist  # in higher bins of this block
                r, b = np.nonzero((hist > 0) & (over < k))  # deeper bins can't hold the k-th score
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(r), q["block"])), pa.array((r + q["first"]).astype(np.int32)),
                     pa.array(b.astype(np.int32)), pa.array(hist[r, b])], ["block", "row", "bin", "n"])
        return run

    while True:
        q = left if state is None else left.join(state, left["q_block"] == state["s_block"]).drop("s_block")
        hist = meet(q).mapInArrow(counted(width, span, state is None), "block long, row int, bin int, n long") \
            .groupBy("block", "row", "bin").agg(F.sum("n").alias("n"))
        if state is not None:
            base = state.select(F.col("s_block").alias("block"), F.posexplode(F.arrays_zip("q_low", "q_above")).alias("row", "was")) \
                .select("block", "row", F.col("was.q_low").alias("low0"), F.col("was.q_above").alias("above0"))
            hist = hist.join(base, ["block", "row"])
        else:
            hist = hist.withColumn("low0", F.lit(-reach).cast("long")).withColumn("above0", F.lit(0).cast("long"))
        # at most k * blocks rows per query
        w = Window.partitionBy("block", "row").orderBy(F.desc("bin"))
        run = hist.withColumn("upto", F.sum("n").over(w) + F.col("above0")) \
            .withColumn("last", F.row_number().over(Window.partitionBy("block", "row").orderBy("bin")))
        # the bin where the count reaches k, or the lowest one if there are fewer than k
        pick = run.where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k) | (F.col("upto") < k) & (F.col("last") == 1))
        exact = lambda x: x.cast("decimal(19,0)")
        low = (exact(F.col("low0")) + F.col("bin").cast("decimal(10,0)") * exact(F.lit(width))).cast("long")
        chosen = pick.select("block", "row", low.alias("low"), (F.col("upto") - F.col("n")).alias("above"))
        # one row per query block; a block is bounded, and queries without any candidate keep an unreachable bound
        rows = asks.select(F.col("block"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
        full = rows.join(chosen, ["block", "row"], "left").select("block", F.struct(
            "row", F.coalesce("low", F.lit(reach + 1)).alias("low"), F.coalesce("above", F.lit(0)).alias("above")).alias("x"))
        state = cut(full.groupBy("block").agg(F.sort_array(F.collect_list("x")).alias("x"))
                    .select(F.col("block").alias("s_block"), F.col("x.low").cast("array<long>").alias("q_low"), F.col("x.above").cast("array<long>").alias("q_above")))
        if width == 1:
            break
        span, width = width, max(1, math.ceil(width / BINS))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, c, s in _meetings(batches):
            at = slice(q["first"], q["first"] + len(q["ids"]))
            low, above = np.array(q["low"][at]), np.array(q["above"][at])
            ids, rows, scores, parts = c["ids"], [], [], []
            for i in range(len(low)):
                own = np.flatnonzero(s[i] > low[i])
                ties = np.flatnonzero(s[i] == low[i])
                need = k - above[i]
                if len(ties) > need:
                    ties = ties[np.argpartition(ids[ties], need - 1)[:need]] if need > 0 else ties[:0]
                own = np.concatenate((own, ties))
                rows.append(np.full(len(own), i))
                scores.append(s[i][own])
                parts.append(ids[own])
            r = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(r), q["block"])), pa.array((r + q["first"]).astype(np.int32)), pa.array(q["ids"][r]),
                 pa.array(np.concatenate(parts)), pa.array(np.concatenate(scores))], ["block", "row", "query_id", "vec_id", "score"])

    best = meet(left.join(state, left["q_block"] == state["s_block"]).drop("s_block")) \
        .mapInArrow(final, "block long, row int, query_id long, vec_id long, score long")
    w = Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
