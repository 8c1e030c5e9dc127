"""Connected components of an edge list, with no node's neighbours gathered in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of edges and the smallest node reachable from each, within these edges."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            return nodes, nodes[label]
        label = low


#: Edges that one task contracts at a time.
BATCH = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to BATCH edges at a time as stars around their own smallest nodes: never more edges than before."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, root = roots(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
        own = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(root[own])], ["u", "v"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= BATCH:
            yield stars(held)
            held, size = [], 0
    if size:
        yield stars(held)


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node of it) of every node that has an edge; ``edges``: a, b (long).

    Alternating large-star and small-star rounds after contracting the edges twice, where they lie and
    dealt out in shares of about BATCH, which leaves few rounds; nodes of very many edges meet their
    minimum by a broadcast of bounded size.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    near = stored(pairs.mapInArrow(_contract, "u long, v long"))
    shares = max(2, -(-near.count() // BATCH))
    e = stored(near.repartition(shares, "u", "v").mapInArrow(_contract, "u long, v long").distinct())

    def open_ends(x: DataFrame) -> bool:
        """Whether a node has two edges upwards, or one upwards and one downwards: then it isn't stars yet."""
        ends = x.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                          F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("end"))
        return not ends.groupBy("end.x").agg(F.sum("end.up").alias("up"), F.max("end.down").alias("down")).where("up + down > 1 and up > 0").isEmpty()

    while open_ends(e):
        n = e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = stored(hot_join(both, low, ["u"], "n", 2 * n).where("v > u and v <> m")
                       .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = hot_join(large, low, ["u"], "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        e = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
