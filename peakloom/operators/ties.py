"""Ties of a ranked list in closed form: no array as long as a tie, whatever its size.

A tie is a block of ``size`` entries at one distance, ``hits`` of them relevant, ``before`` entries
ahead of it. In a random order the first relevant one sits at offset R (from 0), and
P(R >= t) = C(size - t, hits) / C(size, hits).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import uniform

#: Offsets that are summed one by one; beyond them panels of 1/128 of their offset (error below 1e-8 of a reciprocal rank).
EXACT = 4096
_PANELS = 128

# --- fixed values: cutoffs and definitions of the tie report ---
CUTOFFS = (1, 5, 10)
CROSSING = "n_better < cutoff and n_better + tie_size > cutoff"
AFFECTED = ("optimistic_hit_differs_from_pessimistic_hit_at_cutoff; "
            "tie_size_greater_than_1_alone_is_not_affected")


def harmonic(before: Column, n: Column) -> Column:
    """1/(before+1) + ... + 1/(before+n): 16 terms, then the asymptotic series of harmonic numbers."""
    head = F.lit(0.0)
    for i in range(1, 17):
        head = head + F.when(n >= i, 1.0 / (before + i)).otherwise(0.0)

    def series(x: Column) -> Column:
        y = 1.0 / (x * x)
        return 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))

    a, z = (before + 16).cast("double"), (before + n).cast("double")
    return head + F.when(n > 16, F.log1p((n - 16) / a) + series(z) - series(a)).otherwise(0.0)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series eight steps up."""
    x = x.cast("double")
    up, y = x + 8, 1.0 / ((x + 8) * (x + 8))
    steps = x
    for i in range(1, 8):
        steps = steps * (x + i)
    return (up - 0.5) * F.log(up) - up + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / up - F.log(steps)


def none_among(t: Column, size: Column, hits: Column) -> Column:
    """P(R >= t): no relevant entry among the first t of the block."""
    lost = log_gamma(size - t + 1) - log_gamma(size - t - hits + 1) + log_gamma(size - hits + 1) - log_gamma(size + 1)
    return F.when(t <= 0, 1.0).when(t > size - hits, 0.0).otherwise(F.exp(lost))


def chance_within(k: int, before: Column, size: Column, hits: Column) -> Column:
    """P(the first relevant entry has a rank of at most k), a product of at most k factors."""
    none = F.lit(1.0)
    for i in range(k):
        none = none * F.when(before + i < k, F.greatest(F.lit(0), size - hits - i) / F.greatest(F.lit(1), size - i)).otherwise(1.0)
    return 1.0 - none


def expected_reciprocal(before: Column, size: Column, hits: Column) -> Column:
    """E[1 / (before + R + 1)]."""
    last = size - hits
    start = F.struct((hits / size).alias("p"), F.lit(0.0).alias("s"))
    exact = F.aggregate(
        F.sequence(F.lit(0), F.least(last, F.lit(EXACT - 1)).cast("int")), start,
        lambda a, r: F.struct((a["p"] * F.greatest(F.lit(0), last - r) / F.greatest(F.lit(1), size - 1 - r)).alias("p"),
                              (a["s"] + a["p"] / (before + r + 1)).alias("s")),
        lambda a: a["s"])
    edges = F.ceil(F.log(last / F.lit(float(EXACT))) / F.log1p(F.lit(1 / _PANELS))).cast("int")

    def panel(a: Column, i: Column) -> Column:
        stop = F.least(last + 1, F.ceil(a["t"] * (1 + 1 / _PANELS)).cast("long"))
        left = none_among(stop, size, hits)
        return F.struct(stop.alias("t"), left.alias("p"), (a["s"] + (a["p"] - left) / (before + (a["t"] + stop + 1) / 2.0)).alias("s"))

    first = F.struct(F.lit(EXACT).cast("long").alias("t"), none_among(F.lit(EXACT), size, hits).alias("p"), F.lit(0.0).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(0), edges), first, panel, lambda a: a["s"])
    return exact + F.when(last >= EXACT, tail).otherwise(0.0)


def drawn_offset(u: Column, size: Column, hits: Column) -> Column:
    """R for a uniform u: how many t >= 1 have P(R >= t) > u, found by halving."""
    start = F.struct(F.lit(0).cast("long").alias("lo"), (size - hits).cast("long").alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"] + 1) / 2)
        more = none_among(mid, size, hits) > u
        return F.struct(F.when(more, mid).otherwise(a["lo"]).alias("lo"),
                        F.when(more, a["hi"]).otherwise(F.greatest(a["lo"], mid - 1)).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(size - hits + 2.0)).cast("int")), start, halve, lambda a: a["lo"])


def first_relevant(ranked: DataFrame) -> DataFrame:
    """q_pos, before, size, hits of each query's first tie with a relevant entry; ``ranked``: q_pos, distance, relevant."""
    blocks = ranked.groupBy("q_pos", "distance").agg(F.count("*").alias("size"), F.count_if("relevant").alias("hits"))
    w = Window.partitionBy("q_pos").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    return b.filter("hits > 0").groupBy("q_pos").agg(F.min_by(F.struct("before", "size", "hits"), "distance").alias("f")).select("q_pos", "f.*")


def _levels(ranked: DataFrame, coarse: DataFrame | None) -> DataFrame:
    """First ties under the fine identity and, where given, the coarse one (``fine`` false)."""
    x = first_relevant(ranked).withColumn("fine", F.lit(True))
    return x if coarse is None else x.unionByName(first_relevant(coarse).withColumn("fine", F.lit(False)))


def tie_sensitivity(ranked: DataFrame, coarse: DataFrame | None = None, seed: int | None = None) -> DataFrame:
    """metric, tie_policy, estimate, n_queries: means over queries with each tie counted best, at random on average, worst.

    ``ranked`` and ``coarse`` hold (q_pos, distance, relevant) of finite candidates under the fine and the coarse
    identity; p_at_1 rests on the coarse one. With ``seed`` a policy ``random`` draws one order per query.
    Queries without a relevant entry take no part; without any query the estimate is NULL.
    """
    before, size, hits = F.col("before"), F.col("size"), F.col("hits")
    best, worst = before + 1, before + size - hits + 1
    drawn = F.col("drawn")
    x = _levels(ranked, coarse).withColumn("drawn", before + 1 + drawn_offset(uniform(seed, F.col("q_pos"), F.col("fine")), size, hits)
                                           if seed is not None else F.lit(None).cast("long"))

    def hit(rank: Column, k: int) -> Column:
        return (rank <= k).cast("double")

    named = [(f"top{k}", True, [hit(best, k), chance_within(k, before, size, hits), hit(worst, k), hit(drawn, k)]) for k in CUTOFFS]
    named.append(("mrr", True, [1.0 / best, expected_reciprocal(before, size, hits), 1.0 / worst, 1.0 / drawn]))
    if coarse is not None:
        named.append(("p_at_1", False, [hit(best, 1), chance_within(1, before, size, hits), hit(worst, 1), hit(drawn, 1)]))
    policies = ["optimistic", "fractional", "pessimistic"] + ["random"] * (seed is not None)
    cells = [(metric, policy, F.when(F.col("fine") == fine, v)) for metric, fine, values in named for policy, v in zip(policies, values)]
    means = x.agg(*[f(v).alias(f"{c}{i}") for i, (_, _, v) in enumerate(cells) for c, f in (("m", F.avg), ("n", F.count))])
    return means.select(F.inline(F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.lit(policy).alias("tie_policy"), F.col(f"m{i}").alias("estimate"), F.col(f"n{i}").alias("n_queries"))
        for i, (metric, policy, _) in enumerate(cells)])))


def tie_effects(ranked: DataFrame, coarse: DataFrame | None = None) -> DataFrame:
    """How many queries a tie at the first relevant entry touches, per cutoff: one row for each of top1, top5, top10 and (coarse) p_at_1.

    A tie crosses a cutoff when entries of it lie on both sides; a query is affected when the best and the
    worst order disagree on the hit. A tie alone does not make a query affected. Shares are NULL without queries.
    """
    before, size, hits = F.col("before"), F.col("size"), F.col("hits")
    named = [("fine", f"top{k}", k) for k in CUTOFFS] + ([("coarse", "p_at_1", 1)] if coarse is not None else [])
    sums = []
    for i, (level, _, k) in enumerate(named):
        own = F.col("fine") == (level == "fine")
        crossing = (before < k) & (before + size > k)
        affected = (before < k) & (before + size - hits + 1 > k)
        sums += [F.count_if(own).alias(f"n{i}"), F.count_if(own & (size > 1)).alias(f"t{i}"), F.count_if(own & crossing).alias(f"c{i}"),
                 F.count_if(own & affected).alias(f"a{i}"), F.count_if(own & (size > 1) & ~affected).alias(f"u{i}")]

    def share(part: str, i: int) -> Column:
        return F.when(F.col(f"n{i}") > 0, F.col(f"{part}{i}") / F.col(f"n{i}"))

    return _levels(ranked, coarse).agg(*sums).select(F.inline(F.array(*[F.struct(
        F.lit(level).alias("identity_level"), F.lit(metric).alias("metric"), F.lit(k).alias("cutoff"),
        F.col(f"n{i}").alias("n_queries_evaluated"), F.col(f"t{i}").alias("n_with_relevant_tie"), share("t", i).alias("proportion_with_relevant_tie"),
        F.col(f"c{i}").alias("n_tie_blocks_crossing_cutoff"), F.col(f"a{i}").alias("n_optimistic_pessimistic_crossings"),
        F.col(f"a{i}").alias("n_affected"), share("a", i).alias("proportion_affected"), F.col(f"u{i}").alias("n_tied_not_affected"),
        F.lit(CROSSING).alias("tie_block_crossing_definition"), F.lit(AFFECTED).alias("affected_definition"))
        for i, (level, metric, k) in enumerate(named)])))
