"""Neighbour-graph embedding: fuzzy nearest-neighbour graph, spectral start, attraction and repulsion.

Every step is a Spark job whose work follows the number of edges (spectra x neighbours):

* neighbours    - the k nearest of each spectrum from the block join, over all spectra
* graph         - membership strengths by bisection on Arrow batches, joined to a symmetric graph
* spectral start - power iteration on the normalised graph; only a few sums per round reach the driver
* layout        - epochs of pulls summed over edges and pushes from a random block of spectra

A spectrum that many others have as neighbour (the first of a group of copies) has its edges
dealt over several join keys, so no task holds all edges of a hub.

Defined results: fewer than 3 spectra and a bad number of neighbours are errors; a spectrum
without any finite distance has no edges and is placed by its start and the pushes alone.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import nearest
from .clustering import ClusterScorer, ensure_checkpoint_dir, with_ri

#: A join key holds at most one edge in HUB_SHARE (or FEW_EDGES), so at most HUB_SHARE spectra are hubs.
HUB_SHARE, FEW_EDGES = 2000, 4096
#: Spectra of one block of pushes, on average.
BLOCK = 256
#: Power steps between two rounds of orthogonal directions.
ROUND = 5

# --- fixed values: pushes per pull, bounds of the bisection (log2) and smallest scale by mean distance ---
PUSHES = 5
SCALE_RANGE, SCALE_STEPS, SCALE_FLOOR = 20.0, 48, 1e-3


def table_cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again: computed once, lineage cut."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/layout-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def default_neighbors(n: int) -> int:
    return min(10, max(2, n // 3))


def check_neighbors(n: int, n_neighbors: int | None) -> int:
    if n < 3:
        raise ValueError("the embedding needs at least 3 spectra")
    if n_neighbors is None:
        return default_neighbors(n)
    if int(n_neighbors) != n_neighbors or not 2 <= n_neighbors < n:
        raise ValueError("n_neighbors must be an integer between 2 and the number of spectra minus 1")
    return int(n_neighbors)


def strengths(distance: np.ndarray, n_neighbors: int) -> np.ndarray:
    """Membership strengths of rows of distances (inf where a row is shorter).

    The nearest positive distance has strength 1; the scale is the one whose strengths sum to
    log2(n_neighbors), found by bisection over all rows at once.
    """
    known = np.isfinite(distance)
    rho = np.where(known & (distance > 0), distance, np.inf).min(1, initial=np.inf)
    rho = np.where(np.isfinite(rho), rho, 0.0)[:, None]
    gap = np.where(known, np.maximum(distance - rho, 0.0), np.inf)
    target = math.log2(n_neighbors)
    lo, hi = np.full(len(gap), -SCALE_RANGE), np.full(len(gap), SCALE_RANGE)
    for _ in range(SCALE_STEPS):
        mid = (lo + hi) / 2
        above = np.exp(-gap / np.exp2(mid)[:, None]).sum(1) > target
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
    mean = np.where(known, distance, 0.0).sum(1) / np.maximum(known.sum(1), 1)
    scale = np.maximum(np.exp2((lo + hi) / 2), SCALE_FLOOR * mean)[:, None]
    return np.where(known, np.exp(-gap / scale), 0.0)


def neighbour_graph(spectra: DataFrame, p, n_neighbors: int | None = None, fragment_only: bool = False) -> DataFrame:
    """(a, b, weight) in both directions: fuzzy union of the strengths either spectrum gives the other.

    ``n_neighbors`` counts the spectrum itself, as usual for this kind of graph.
    """
    k = check_neighbors(spectra.count(), n_neighbors)
    x = with_ri(spectra, p)

    hits = nearest(x, x, ClusterScorer(p, fragment_only), k - 1, exclude_self="pos")
    rows = hits.groupBy("q_pos").agg(F.collect_list(F.struct("distance", "l_pos")).alias("near"))  # k - 1 at most

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            size = near.value_lengths().to_numpy()
            flat = near.flatten()
            row, column = np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(s) for s in size] or [np.zeros(0, int)])
            d = np.full((len(size), k - 1), np.inf)
            d[row, column] = flat.field("distance").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("q_pos").take(pa.array(row)), flat.field("l_pos"), pa.array(strengths(d, k)[row, column])],
                ["a", "b", "w"])

    one_way = rows.mapInArrow(weigh, "a long, b long, w double")
    # union of both directions: u + v - u v, where a missing direction is 0
    pair = one_way.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(
        F.sum("w").alias("_s"), F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0).alias("_p"))
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    return pair.select(ends, (F.col("_s") - F.col("_p")).alias("weight")).select("e.a", "e.b", "weight")


def curve_parameters(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^(2b)) nearest to a curve that is 1 up to ``min_dist`` and decays by ``spread`` beyond it."""
    x = np.linspace(0, 3 * spread, 301)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))

    def model(v):
        return 1 / (1 + np.exp(v[0]) * x ** (2 * np.exp(v[1])))

    v, damp = np.zeros(2), 1e-2
    rest = y - model(v)
    for _ in range(200):
        jac = np.stack([(model(v + h) - model(v - h)) / 2e-6 for h in np.eye(2) * 1e-6], 1)
        step = np.linalg.solve(jac.T @ jac + damp * np.eye(2), jac.T @ rest)
        new = y - model(v + step)
        if new @ new < rest @ rest:
            v, rest, damp = v + step, new, damp / 3
        else:
            damp *= 4
        if np.abs(step).max() < 1e-10:
            break
    return float(np.exp(v[0])), float(np.exp(v[1]))


class Graph:
    """Edges with hubs dealt over several keys, and the degrees of all nodes."""

    def __init__(self, edges: DataFrame, nodes: DataFrame):
        edges = table_cut(edges)
        most = max(edges.count() // HUB_SHARE, FEW_EDGES)
        per = edges.groupBy("a").agg(F.sum("weight").alias("degree"), F.count("*").alias("_n"))
        joined = nodes.select("node").join(per.withColumnRenamed("a", "node"), "node", "left")
        self.nodes = table_cut(joined.select(
            "node", F.coalesce("degree", F.lit(0.0)).alias("degree"),
            F.ceil(F.coalesce("_n", F.lit(1)) / most).cast("int").alias("shares")))
        # an edge names the share of either end that it meets; only hubs, HUB_SHARE at most, have more than one
        hubs = self.nodes.where("shares > 1").select("node", "shares")
        for end, other in (("a", "b"), ("b", "a")):
            many = hubs.select(F.col("node").alias(end), F.col("shares").alias("_m"))
            edges = edges.join(F.broadcast(many), end, "left").withColumn(
                f"s{end}", F.pmod(F.xxhash64(other), F.coalesce("_m", F.lit(1))).cast("int")).drop("_m")
        self.edges = table_cut(edges)

    def meet(self, end: str, state: DataFrame, columns: list[str], prefix: str, edges: DataFrame | None = None) -> DataFrame:
        """Edges with ``columns`` of the node at ``end``; ``state`` has node, shares and them."""
        dealt = state.select(F.col("node").alias(end), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias(f"s{end}"),
                             *[F.col(c).alias(prefix + c) for c in columns])
        return (self.edges if edges is None else edges).join(dealt, [end, f"s{end}"])


def _uniform(seed: int, *keys) -> F.Column:
    """Draw in [-1, 1), a function of the keys alone."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / float(1 << 29) - 1.0


def spectral_start(graph: Graph, n_components: int = 2, steps: int = 15, seed: int = 71) -> DataFrame:
    """(node, degree, shares, V1..): leading directions of the normalised graph after the trivial one, scaled to 10.

    Power iteration with the walk that stays put half of the time; the directions are made
    orthogonal to the trivial one and to each other from their inner products, which is all that
    the driver sees.
    """
    names = [f"V{c + 1}" for c in range(n_components)]
    root = F.sqrt("degree")
    state = graph.nodes.select("*", root.alias("V0"), *[_uniform(seed, F.lit(c), "node").alias(v) for c, v in enumerate(names)])
    every = ["V0"] + names
    state = table_cut(state)
    for at in range(0, steps + 1, ROUND):
        state = state.select("node", "degree", "shares", "V0", *_orthogonal(state, every))
        if at >= steps:
            break
        for _ in range(min(ROUND, steps - at)):
            seen = state.withColumns({v: F.when(F.col("degree") > 0, F.col(v) / root).otherwise(0.0) for v in names})
            moved = graph.meet("b", seen, names, "_").groupBy(F.col("a").alias("node")).agg(
                *[F.sum(F.col("weight") * F.col(f"_{v}")).alias(f"_{v}") for v in names])
            state = table_cut(state.join(moved, "node", "left").select(
                "node", "degree", "shares", "V0",
                *[((F.col(v) + F.coalesce(F.when(F.col("degree") > 0, F.col(f"_{v}") / root), F.lit(0.0))) / 2).alias(v) for v in names]))
    top = state.agg(*[F.max(F.abs(v)).alias(v) for v in names]).first()
    # a little noise parts nodes that the graph can't tell apart
    return state.select("node", "degree", "shares", *[
        (F.col(v) * (10.0 / (top[v] or 1.0)) + 1e-3 * _uniform(seed + 1, F.lit(c), "node")).alias(v) for c, v in enumerate(names)])


def _orthogonal(state: DataFrame, names: list[str]) -> list:
    """Expressions of names[1:], orthonormal among each other and to names[0], from one aggregate of inner products."""
    m = len(names)
    sums = state.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i in range(m) for j in range(i, m)]).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(m)] for i in range(m)])
    made = np.zeros((m, m))  # rows: combinations of the given columns
    for i in range(m):
        own = np.eye(m)[i]
        for done in made[:i]:
            own = own - (own @ gram @ done) * done
        size = own @ gram @ own
        made[i] = own / math.sqrt(size) if size > 1e-24 else 0.0
    return [sum((F.lit(float(made[i, j])) * F.col(names[j]) for j in range(m)), F.lit(0.0)).alias(names[i]) for i in range(1, m)]


def pushes(y: np.ndarray, a: float, b: float) -> np.ndarray:
    """Mean push on every row of ``y`` from the other rows, each component of a push at most 4."""
    gap = y[:, None, :] - y[None, :, :]
    d2 = (gap ** 2).sum(2)
    force = 2 * b / ((0.001 + d2) * (1 + a * d2 ** b))
    return np.clip(force[:, :, None] * gap, -4, 4).sum(1) / max(len(y) - 1, 1)


def _pusher(names: list[str], factor: float, a: float, b: float):
    def push(table: pa.Table) -> pa.Table:
        moved = factor * pushes(np.stack([table.column(v).to_numpy() for v in names], 1), a, b)
        return pa.table({"node": table.column("node"), **{v: moved[:, c] for c, v in enumerate(names)}})

    return push


def embed(spectra: DataFrame, p, n_neighbors: int | None = None, min_dist: float = 0.05, n_components: int = 2, seed: int = 71,
          epochs: int = 20, fragment_only: bool = False) -> DataFrame:
    """(id, pos, V1..): coordinates from the neighbour graph of all spectra.

    Each epoch moves all spectra at once: the weighted mean of the pulls along their edges, none
    of which takes a spectrum past the middle, and the mean push from a random block.
    """
    nodes = spectra.select(F.col("pos").cast("long").alias("node"), F.col("id").cast("string").alias("id"))
    graph = Graph(neighbour_graph(spectra, p, n_neighbors, fragment_only), nodes)
    names = [f"V{c + 1}" for c in range(n_components)]
    a, b = curve_parameters(min_dist)
    blocks = max(1, graph.nodes.count() // BLOCK)
    schema = "node long, " + ", ".join(f"{v} double" for v in names)
    state = table_cut(spectral_start(graph, n_components, seed=seed))
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        both = graph.meet("a", state, names + ["degree"], "p", graph.meet("b", state, names, "q"))
        d2 = sum(((F.col(f"p{v}") - F.col(f"q{v}")) ** 2 for v in names), F.lit(0.0))
        pull = F.when(d2 > 0, F.least(2 * a * b * F.pow(d2, F.lit(b - 1)) / (1 + a * F.pow(d2, F.lit(b))), F.lit(0.5))).otherwise(0.0)
        share = rate * F.col("weight") / F.col("pdegree") * pull
        pulled = both.select(F.col("a").alias("node"), *[(share * (F.col(f"q{v}") - F.col(f"p{v}"))).alias(v) for v in names])
        dealt = state.select("node", *names, F.pmod(F.xxhash64("node", F.lit(seed + epoch)), F.lit(blocks)).alias("_block"))
        pushed = dealt.groupBy("_block").applyInArrow(_pusher(names, rate * PUSHES / 2, a, b), schema)
        moves = pulled.unionByName(pushed).groupBy("node").agg(*[F.sum(v).alias(f"_{v}") for v in names])
        # one table an epoch: its size is known, so Spark broadcasts it only while it is small
        state = table_cut(state.join(moves, "node", "left").select(
            "node", "degree", "shares", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0.0))).alias(v) for v in names]))
    return nodes.join(state, "node").select("id", F.col("node").alias("pos"), *names)
