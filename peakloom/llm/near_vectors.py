"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosine verification and components.

1. Equal vectors of one label are one class with a count; classes are what is hashed and compared.
2. Each class has a signature of ``bits`` signs in each of several tables. The number of bits follows from the
   largest label's classes, so that unrelated vectors seldom share a bucket, and the number of tables from the bits,
   so that a pair exactly at the threshold is missed with a chance of ``miss``.
3. Buckets are counted by hash before any vector moves; only the members of buckets with company fetch their
   vectors. A bucket of more than ``CELL`` classes is cut into blocks, and each two blocks meet in a cell of their own.
4. A cell verifies by cosines in double precision, counts a pair only in the first table in which it meets, and
   emits a partial number of links and a root for each class, never its pairs.
5. Components of the roots by star contraction; links and components go back to all rows.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and rows without label,
link with nothing and are their own component; vectors of different length never link; cosines don't depend on a
vector's length, very large and very small components included; every row counts as a vector of its own, repeated ids too; a
row without id counts as a link but never names a component (a component of such rows only is null); ``kept`` compares
null-safely; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, mixed, shuffle_width, stored
from .graph import components, roots

#: Classes in one block of a large bucket.
CELL = 512
SEED = 20_011


def shape(classes: int, threshold: float, miss: float) -> tuple[int, int]:
    """bits and tables for labels of at most ``classes`` classes."""
    bits = min(40, max(8, math.ceil(math.log2(max(classes, 1))) + 3))
    same = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    hit = same ** bits
    return bits, 1 if hit >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-hit)))


def units(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, one after the other, and their lengths; scaled by the largest component first."""
    dims = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(dims)[:-1]))
    scaled = flat / np.repeat(np.maximum.reduceat(np.abs(flat), starts), dims)
    return scaled / np.repeat(np.sqrt(np.add.reduceat(scaled * scaled, starts)), dims), dims


def signatures(rows: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One integer per row and table."""
    planes = np.random.default_rng(SEED + rows.shape[1]).standard_normal((rows.shape[1], bits * tables))
    signs = (rows @ planes > 0).reshape(len(rows), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def _buckets(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                flat, dims = units(b.column("v"))
                ends = np.cumsum(dims)
                node, label = b.column("node").to_numpy(), b.column("label").to_numpy()
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    signs = signatures(flat[(ends[own] - dim)[:, None] + np.arange(dim)], bits, tables)
                    place = mixed(label[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim))
                    table = np.arange(tables, dtype=np.int32)
                    bucket = mixed(mixed(place[:, None] + table.astype(np.uint64)) ^ signs.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket.view(np.int64).ravel()), pa.array(np.tile(table, len(own))), pa.array(np.repeat(node[own], tables))],
                        ["bucket", "table", "node"])
    return run


def _verified(held: pa.Table, bits: int, tables: int, threshold: float) -> pa.RecordBatch | None:
    """node, links, root of the classes that link within the cells of ``held``, whose cells are whole and contiguous."""
    cell = np.stack([held.column(c).to_numpy() for c in ("bucket", "i", "j")])
    starts = np.flatnonzero(np.concatenate(([True], (cell[:, 1:] != cell[:, :-1]).any(0))))
    sizes = np.diff(np.append(starts, held.num_rows))
    node, label, n, block, table = (held.column(c).to_numpy() for c in ("node", "label", "n", "block", "table"))
    flat, dims = units(held.column("v").combine_chunks())
    ends = np.cumsum(dims)
    low, high = [], []
    for dim in np.unique(dims):
        for size in np.unique(sizes[dims[starts] == dim]):
            first = starts[(sizes == size) & (dims[starts] == dim)]
            step = max(1, (1 << 20) // int(size * size))
            for at in range(0, len(first), step):
                rows = first[at:at + step, None] + np.arange(size)
                rows = rows[(dims[rows] == dim).all(1)]  # two lengths in one bucket only by a collision of hashes
                x = flat[(ends[rows] - dim)[..., None] + np.arange(dim)]
                g, a, b = np.nonzero(np.triu(x @ x.transpose(0, 2, 1) >= threshold, 1))
                low.append(rows[g, a])
                high.append(rows[g, b])
    low, high = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (low, high))
    # a cell of two blocks has the pairs between them only
    keep = (label[low] == label[high]) & ((cell[1, low] == cell[2, low]) | (block[low] != block[high]))
    low, high = low[keep], high[keep]
    if not len(low):
        return None
    mine, at = np.unique(np.concatenate((low, high)), return_inverse=True)
    signs = np.zeros((len(mine), tables), np.int64)
    for dim in np.unique(dims[mine]):
        own = dims[mine] == dim
        signs[own] = signatures(flat[(ends[mine[own]] - dim)[:, None] + np.arange(dim)], bits, tables)
    p, q = at[:len(low)], at[len(low):]
    first = np.ones(len(low), bool)
    for k in range(0, len(low), 1 << 16):
        part = slice(k, k + (1 << 16))
        met = signs[p[part]] == signs[q[part]]
        first[part] = met.argmax(1) == table[low[part]]
    low, high, p, q = low[first], high[first], p[first], q[first]
    if not len(low):
        return None
    links = np.bincount(p, n[high], len(mine)) + np.bincount(q, n[low], len(mine))
    own = np.flatnonzero(links)
    nodes, root = roots(node[low], node[high])
    # one row for each class of these cells
    names, place = np.unique(node[mine[own]], return_inverse=True)
    total = np.bincount(place, links[own], len(names)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array(root[np.searchsorted(nodes, names)])], ["node", "links", "root"])


def _verify(bits: int, tables: int, threshold: float, most: int = 8192):
    """Whole cells, some ``most`` rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                held.append(whole.slice(at, most))
                if sum(b.num_rows for b in held) < most:
                    continue
                rows = pa.Table.from_batches(held)
                cell = np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")])
                other = np.flatnonzero((cell != cell[:, -1:]).any(0))
                done = other[-1] + 1 if len(other) else 0  # the last cell may go on
                if done and (out := _verified(rows.slice(0, done), bits, tables, threshold)):
                    yield out
                held = rows.slice(done).to_batches()
        if sum(b.num_rows for b in held) and (out := _verified(pa.Table.from_batches(held), bits, tables, threshold)):
            yield out
    return run


def links(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98,
          miss: float = 1e-6) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row for each row of ``vectors``."""
    raw, label = F.col(vector_col), F.col(label_col)
    fine = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(raw, lambda x: x != 0)
    takes = F.coalesce(label.isNotNull() & raw.isNotNull() & fine, F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), takes.alias("takes"), label.cast("long").alias("label"), raw.alias("v")) \
        .withColumns({"d1": F.xxhash64("label", "v"), "d2": F.xxhash64("v", F.lit(SEED), "label")})
    classes = stored(rows.where("takes").groupBy("d1", "d2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
                     .withColumn("node", F.monotonically_increasing_id()))
    total = classes.agg(F.sum("n")).first()[0] or 0
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = shape(largest, threshold, miss)

    buckets = classes.select("node", "label", "v").mapInArrow(_buckets(bits, tables), "bucket long, table int, node long")
    crowded = stored(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    members = hot_join(buckets, crowded.withColumn("blocks", F.ceil(F.col("size") / CELL).cast("int")), ["bucket"], "size",
                       crowded.agg(F.sum("size")).first()[0] or 0).where("blocks is not null")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))))
    placed = members.withColumn("block", block).select("bucket", "table", "node", "block", cells.alias("cell")).select("bucket", "table", "node", "block", "cell.*")
    met = placed.join(classes.select("node", "label", "n", "v"), "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = stored(met.mapInArrow(_verify(bits, tables, threshold), "node long, links long, root long"))

    direct = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("d1", "d2", "node", "least", "n").join(direct, "node", "left").join(reached, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    named = stored(named)
    firsts = stored(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    of_class = stored(hot_join(named, firsts, ["component"], "members", named.count())
                      .select("d1", "d2", "n", F.coalesce("links", F.lit(0)).alias("links"), F.col("n").alias("copies"), "component_id"))
    own = rows.where("takes").select("vec_id", "d1", "d2")
    inside = hot_join(own, of_class, ["d1", "d2"], "n", total).select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.where("not takes").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_near_vectors(spark, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP11_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM e WHERE label IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
l AS (SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.label = b.label AND a.k <> b.k AND len(a.v) = len(b.v)
    AND list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
r AS (SELECT k AS a, k AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS k, min(e.vec_id) AS component_id FROM r JOIN e ON e.k = r.b GROUP BY 1),
n AS (SELECT a AS k, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN c USING (k) LEFT JOIN n USING (k)
"""
