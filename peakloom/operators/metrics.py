"""Retrieval, discrimination and agreement metrics over long distance tables.

A distance table holds (query_id, q_pos, library_id, l_pos, distance).  Per-query
ranks are windows partitioned by query; everything global is a partial aggregate, so
no step sees all pairs in one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.peaks import is_finite
from .blocks import Scorer, Several, block_apply, fold, in_order, row_apply, same_key, sides, to_table
from .ties import chance_within, expected_reciprocal, first_relevant, harmonic

# --- fixed values: default report settings ---
K_VALUES = (1, 5, 10, 20)
FDR_THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
TRANSFORMS = ("linear", "linear_clamp", "minmax", "reciprocal", "exponential")


def key_prefix(key, chars: int = 14):
    """First ``chars`` characters; blank becomes NULL."""
    return F.nullif(F.substring(key, 1, chars), F.lit(""))


def strict_prefix(key, chars: int = 14):
    """Like key_prefix, but keys shorter than ``chars`` become NULL."""
    return F.when(F.length(key) >= chars, F.substring(key, 1, chars))


def attach_keys(pairs: DataFrame, labels: DataFrame, library_labels: DataFrame | None = None) -> DataFrame:
    """Join ``key`` of both sides by position (labels: pos, key)."""
    if not isinstance(pairs, DataFrame):
        return pairs.with_keys(labels, library_labels)
    q = labels.select(F.col("pos").cast("long").alias("q_pos"), F.col("key").alias("q_key"))
    lib = (labels if library_labels is None else library_labels).select(
        F.col("pos").cast("long").alias("l_pos"), F.col("key").alias("l_key"))
    return pairs.join(q, "q_pos").join(lib, "l_pos")


def with_relevance(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("relevant", F.coalesce(F.col("q_key") == F.col("l_key"), F.lit(False)))


def replicated(labels: DataFrame) -> DataFrame:
    """Rows whose key occurs more than once (partial-aggregated, then semi-joined)."""
    many = labels.filter(F.length("key") > 0).groupBy("key").agg(F.count("*").alias("n_key")).filter("n_key > 1")
    return labels.join(many, "key")


def replicate_ranks(spectra: DataFrame, p, key: str = "inchikey", fragment_only: bool = False,
                    cell: int = 512) -> DataFrame:
    """Optimistic rank (ties = min) of the best same-key spectrum for every query that has one.

    Two block passes: the nearest same-key distance, then the number of strictly
    closer spectra.  Cells emit one row per query, never pairs.
    """
    import numpy as np

    from .blocks import APART, best_strip, equal_matrix, to_table

    scorer = Scorer(p, fragment_only=fragment_only)
    extra = [key] + scorer.extra()
    q, lib = sides(spectra, spectra, scorer.channels(), extra, extra)
    usable = F.length(F.col(f"q_{key}")) > 0
    q = q.filter(usable)

    def keys(lt, rt):
        return equal_matrix(lt.column(f"q_{key}"), rt.column(f"l_{key}"))[0]

    def other(lt, rt):
        return lt.column("q_pos").to_numpy()[:, None] != rt.column("l_pos").to_numpy()[None, :]

    def nearest_same(lt, rt):
        rel = keys(lt, rt) & other(lt, rt)
        d = np.where(rel, scorer.distance(lt, rt, rel), np.inf)
        ok = rel.any(1)
        return to_table("q_pos long, best double", {
            "q_pos": lt.column("q_pos").to_numpy()[ok], "best": d.min(1)[ok]})

    def same_strip(session, a, x, rights):
        t = best_strip(session, a, x, rights, 1, APART["pos"], alike=(f"q_{key}", f"l_{key}"))
        return to_table("q_pos long, best double", {"q_pos": t.column("q_pos").combine_chunks(), "best": t.column("distance").combine_chunks()})

    best = block_apply(q, lib, nearest_same, "q_pos long, best double", cell, merge=fold(["q_pos"], best="min"), scorer=scorer,
                       strip=same_strip).groupBy("q_pos").agg(
        F.min("best").alias("best"))
    q2 = q.join(best, "q_pos")

    def closer(lt, rt):
        # same-key spectra cannot be closer than the best of them
        d = scorer.distance(lt, rt)
        b = lt.column("best").to_numpy()
        less = (d < b[:, None]) & other(lt, rt) & ~keys(lt, rt)
        return to_table("query_id string, q_pos long, n long", {
            "query_id": lt.column("query_id").combine_chunks(), "q_pos": lt.column("q_pos").to_numpy(),
            "n": less.sum(1)})

    def closer_strip(session, a, x, rights):
        b, n = x.column("best").to_numpy(), np.zeros(x.num_rows, np.int64)
        top = np.nextafter(b.astype(np.float32), np.float32(np.inf))[:, None]
        keys, places = session.codes(f"q_{key}", f"l_{key}"), session.codes("q_pos", "l_pos")
        for i, y in rights:
            low = session.lower(a, i)
            rows, cols = np.divmod(np.flatnonzero(low <= top), low.shape[1])
            keep = (keys[0][a][rows] != keys[1][i][cols]) & (places[0][a][rows] != places[1][i][cols])
            rows, cols = rows[keep], cols[keep]
            n += np.bincount(rows[session.chosen(a, i, rows, cols) < b[rows]], minlength=len(n))
        return to_table("query_id string, q_pos long, n long", {
            "query_id": x.column("query_id").combine_chunks(), "q_pos": x.column("q_pos").to_numpy(), "n": n})

    return (block_apply(q2, lib, closer, "query_id string, q_pos long, n long", cell, merge=fold(["query_id", "q_pos"], n="sum"),
                        scorer=scorer, strip=closer_strip)
            .groupBy("query_id", "q_pos").agg((F.sum("n") + 1).alias("best_rank")))


def replicate_ranks_of(spectra: DataFrame, params: list, key: str = "inchikey") -> DataFrame:
    """``replicate_ranks`` of the combined distance under several settings of one method: no, query_id, q_pos, best_rank.

    The channels of all settings travel once; a query's distances are made and ranked inside its task, setting by setting.
    """
    import numpy as np

    scorers = [Scorer(p) for p in params]
    several = Several(scorers)
    q, lib = sides(spectra, spectra, several.channels(), [key, *several.extra()], [key, *several.extra()])
    schema = "no int, query_id string, q_pos long, best_rank long"

    def strip(distances, x, rights, kept):
        same = same_key(x, rights, f"q_{key}", f"l_{key}", kept)
        l_pos = np.concatenate([y.column("l_pos").to_numpy() for y in rights])
        other = x.column("q_pos").to_numpy()[:, None] != l_pos[None, :]
        rel, rest = same & other, ~same & other
        ok = np.flatnonzero(rel.any(1))
        ids, pos, out = x.column("query_id").combine_chunks().take(pa.array(ok)), x.column("q_pos").to_numpy()[ok], []
        for no, scorer in enumerate(scorers):
            d = np.concatenate([scorer.distance(x, y) for y in rights], 1)[ok]
            best = np.where(rel[ok], d, np.inf).min(1)
            out.append(to_table(schema, {"no": np.full(len(ok), no, np.int32), "query_id": ids, "q_pos": pos,
                                         "best_rank": ((d < best[:, None]) & rest[ok]).sum(1) + 1}))
        return pa.concat_tables(out)

    return row_apply(q.filter(F.length(F.col(f"q_{key}")) > 0), lib, strip, schema, several)


def replicate_consistency(ranks: DataFrame) -> DataFrame:
    """Top-1, top-5 and MRR from ``replicate_ranks``."""
    r = F.col("best_rank")
    return ranks.agg(F.avg((r == 1).cast("double")).alias("top1_accuracy"),
                     F.avg((r <= 5).cast("double")).alias("top5_accuracy"),
                     F.avg(1.0 / r).alias("mrr"), F.count("*").alias("n_queries"))


def ranked_square(pairs: DataFrame) -> DataFrame:
    """Ranks of all other spectra per query; non-finite last, ties by position."""
    d = F.when(is_finite(F.col("distance")), F.col("distance"))
    w = Window.partitionBy("q_pos").orderBy(d.asc_nulls_last(), "l_pos")
    return (pairs.filter(F.col("q_pos") != F.col("l_pos"))
            .withColumn("rank", F.row_number().over(w)))


def average_precision(ranked: DataFrame, k_values=K_VALUES) -> DataFrame:
    """Per query: P@k (k capped at the list length) and AP over all relevant entries."""
    hits = F.sum(F.col("relevant").cast("long")).over(
        Window.partitionBy("q_pos").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    x = ranked.withColumn("_hits", hits)
    aggs = [F.count("*").alias("_n"), F.count_if("relevant").alias("n_relevant"),
            F.sum(F.when(F.col("relevant"), F.col("_hits") / F.col("rank"))).alias("_ap"),
            *[F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias(f"_h{k}") for k in k_values]]
    per = x.groupBy("q_pos").agg(*aggs).filter("n_relevant > 0")
    return per.select("q_pos", "n_relevant",
                      *[(F.col(f"_h{k}") / F.least(F.lit(k), F.col("_n"))).alias(f"p_at_{k}") for k in k_values],
                      (F.col("_ap") / F.col("n_relevant")).alias("average_precision"))


def retrieval_rows(pairs, k_values, finite_only: bool) -> DataFrame:
    """Per query of keyed ``AllPairs``: q_pos, entries _n, relevant ones n_relevant, sum _ap of hits / rank over them,
    rank _first of the first, and hits _h{k} among the first k.  A query's distances are ranked inside its task."""
    import numpy as np

    scorer, q, lib = pairs.keyed()
    usable_pairs = pairs.usable()
    names = [f"_h{k}" for k in k_values]
    schema = "q_pos long, _n long, n_relevant long, _ap double, _first long, " + ", ".join(f"{h} long" for h in names)

    def strip(distances, x, rights, kept):
        d = distances()
        usable = usable_pairs(x, rights)
        if finite_only:
            usable &= np.isfinite(d)
        row, rank, n = in_order(d, same_key(x, rights, "q__key", "l__key", kept) & usable, usable)
        size = np.bincount(row, minlength=len(n))
        start = np.cumsum(size) - size
        hits = np.arange(len(row)) - start[row] + 1
        first = np.where(size > 0, np.append(rank, 0)[np.minimum(start, len(rank))] + 1, 0)
        out = {"q_pos": x.column("q_pos").combine_chunks(), "_n": n, "n_relevant": size,
               "_ap": np.bincount(row, hits / (rank + 1), len(n)), "_first": first,
               **{h: np.bincount(row[rank < k], minlength=len(n)) for h, k in zip(names, k_values)}}
        return to_table(schema, out)

    return row_apply(q, lib, strip, schema, scorer)


def precision_at_k(pairs_with_keys, k_values=K_VALUES) -> DataFrame:
    """Mean P@k and MAP over queries whose key occurs elsewhere; takes a table with attached keys or keyed ``AllPairs``."""
    if isinstance(pairs_with_keys, DataFrame) or pairs_with_keys.repeated():
        pairs = pairs_with_keys if isinstance(pairs_with_keys, DataFrame) else pairs_with_keys.rows()
        per = average_precision(ranked_square(with_relevance(pairs)), k_values)
    else:
        per = retrieval_rows(pairs_with_keys, k_values, False).filter("n_relevant > 0").select(
            "q_pos", *[(F.col(f"_h{k}") / F.least(F.lit(k), F.col("_n"))).alias(f"p_at_{k}") for k in k_values],
            (F.col("_ap") / F.col("n_relevant")).alias("average_precision"))
    return per.agg(*[F.avg(f"p_at_{k}").alias(f"p_at_{k}") for k in k_values],
                   F.avg("average_precision").alias("mean_average_precision"),
                   F.count("*").alias("n_queries"))


def library_retrieval(scored: DataFrame, queries: DataFrame, library: DataFrame, k_values=K_VALUES) -> DataFrame:
    """Rectangular retrieval: MAP, MRR, P@k over queries with a relevant library entry.

    ``scored`` carries only usable pairs (gated, finite); queries and library are
    (pos, key).  A query with no usable candidate scores 0, and AP divides by all its
    relevant entries, ranked or not.  ``scored`` may be ``AllPairs`` of the two sets instead.
    """
    n_rel = library.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n_relevant"))
    base = queries.select(F.col("pos").cast("long").alias("q_pos"), "key").join(n_rel, "key")
    if not isinstance(scored, DataFrame) and scored.repeated():
        scored = scored.rows()
    if isinstance(scored, DataFrame):
        s = with_relevance(attach_keys(scored.filter(is_finite(F.col("distance"))), queries, library))
        w = Window.partitionBy("q_pos").orderBy("distance", "l_pos")
        s = s.withColumn("rank", F.row_number().over(w))
        s = s.withColumn("_hits", F.sum(F.col("relevant").cast("long")).over(
            Window.partitionBy("q_pos").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
        per = s.groupBy("q_pos").agg(
            F.sum(F.when(F.col("relevant"), F.col("_hits") / F.col("rank"))).alias("_ap"),
            F.min(F.when(F.col("relevant"), F.col("rank"))).alias("_first"),
            F.count("*").alias("_n"),
            *[F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias(f"_h{k}") for k in k_values])
    else:
        per = retrieval_rows(scored.with_keys(queries, library), k_values, True).filter("_n > 0").drop("n_relevant")
        per = per.withColumn("_first", F.nullif("_first", F.lit(0)))
    joined = base.join(per, "q_pos", "left")
    zero = F.lit(0.0)
    per_query = joined.select(
        "q_pos", F.coalesce(F.col("_ap") / F.col("n_relevant"), zero).alias("average_precision"),
        F.coalesce(1.0 / F.col("_first"), zero).alias("reciprocal_rank"),
        *[F.coalesce(F.col(f"_h{k}") / F.least(F.lit(k), F.col("_n")), zero).alias(f"p_at_{k}")
          for k in k_values])
    return per_query.agg(
        F.avg("average_precision").alias("map"), F.avg("reciprocal_rank").alias("mrr"),
        *[F.avg(f"p_at_{k}").alias(f"p_at_{k}") for k in k_values], F.count("*").alias("n_queries"))


# --- global ranking of scores -----------------------------------------------

def tie_blocks(scored: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """One row per distinct score: n_pos, n_neg (map-side combined)."""
    return scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(positive)).alias("n_pos"), F.count_if(~F.col(positive)).alias("n_neg"))


def with_running_counts(blocks: DataFrame, parts: int = 64) -> DataFrame:
    """Add pos_below / neg_below: totals over strictly smaller scores.

    Distinct scores are cut at quantiles into ``parts`` ranges; a window runs inside
    each range and range totals (at most ``parts`` rows) carry over.
    """
    blocks = blocks.persist()  # read three times below
    qs = [i / parts for i in range(1, parts)]
    cuts = blocks.agg(F.percentile_approx("score", F.array(*[F.lit(x) for x in qs]), F.lit(10000))).first()[0]
    cuts = sorted(set(cuts or []))
    part = F.lit(0)
    if cuts:
        part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("score")))
    b = blocks.withColumn("_part", part)
    w = Window.partitionBy("_part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    prev = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # <= parts rows
    base = (b.groupBy("_part").agg(F.sum("n_pos").alias("p"), F.sum("n_neg").alias("n"))
            .select("_part", F.coalesce(F.sum("p").over(prev), F.lit(0)).alias("_bp"),
                    F.coalesce(F.sum("n").over(prev), F.lit(0)).alias("_bn")))
    out = b.join(F.broadcast(base), "_part")  # bounded by ``parts``
    return out.select("score", "n_pos", "n_neg",
                      (F.coalesce(F.sum("n_pos").over(w), F.lit(0)) + F.col("_bp")).alias("pos_below"),
                      (F.coalesce(F.sum("n_neg").over(w), F.lit(0)) + F.col("_bn")).alias("neg_below"))


def rank_auc(scored: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """Mann-Whitney AUC with average ranks; NULL without both classes."""
    runs = with_running_counts(tie_blocks(scored, score, positive))
    win = F.sum(F.col("n_pos").cast("double") * (F.col("neg_below") + F.col("n_neg") / 2.0))
    out = runs.agg(win.alias("_w"), F.coalesce(F.sum("n_pos"), F.lit(0)).alias("n_positive"),
                   F.coalesce(F.sum("n_neg"), F.lit(0)).alias("n_negative"))
    den = F.col("n_positive").cast("double") * F.col("n_negative")
    return out.select(F.when(den > 0, F.col("_w") / den).alias("auc"), "n_positive", "n_negative")


def roc_points(scored: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """Curve points at every distinct score plus the +Inf and -Inf ends."""
    blocks = tie_blocks(scored.filter(F.col(score).isNotNull()), score, positive)
    runs = with_running_counts(blocks)
    tot = blocks.agg(F.struct(F.sum("n_pos").alias("p"), F.sum("n_neg").alias("n"))).scalar()
    x = runs.withColumn("_t", tot)
    tp = F.col("_t.p") - F.col("pos_below")
    fp = F.col("_t.n") - F.col("neg_below")
    pts = x.select(F.col("score").cast("double").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                   F.try_divide(tp.cast("double"), F.col("_t.p")).alias("tpr"),
                   F.try_divide(fp.cast("double"), F.col("_t.n")).alias("fpr"))
    ends = blocks.agg(F.sum("n_pos").alias("p"), F.sum("n_neg").alias("n")).select(F.explode(F.array(
        F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("fp"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")),
        F.struct(F.lit(float("-inf")).alias("threshold"), F.col("p").alias("tp"), F.col("n").alias("fp"),
                 F.lit(1.0).alias("tpr"), F.lit(1.0).alias("fpr")))).alias("e")).select("e.*")
    return pts.unionByName(ends)


def roc_auc(scored: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """Trapezoid area under the curve.  Between neighbouring tie blocks the curve is a
    straight segment, so the area is a sum over blocks and needs no global sort."""
    return rank_auc(scored, score, positive).select("auc")


# --- similarity of pairs ----------------------------------------------------

def to_similarity(pairs: DataFrame, transform: str = "linear", scale: float | None = None) -> DataFrame:
    """Add ``similarity``; range-based transforms use the q_pos < l_pos pairs."""
    if transform not in TRANSFORMS:
        raise ValueError(f"transform must be one of: {', '.join(TRANSFORMS)}")
    d = F.col("distance")
    if transform == "linear":
        return pairs.withColumn("similarity", 1 - d)
    if transform == "linear_clamp":
        return pairs.withColumn("similarity", 1 - F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0)))
    if transform == "reciprocal":
        return pairs.withColumn("similarity", 1 / (1 + F.greatest(d, F.lit(0.0))))
    upper = pairs.filter((F.col("q_pos") < F.col("l_pos")) & is_finite(d))
    if transform == "exponential":
        if scale is not None and not (scale > 0 and scale != float("inf")):
            raise ValueError("scale must be a positive finite number")
        s = F.lit(float(scale)) if scale else upper.filter(d > 0).agg(
            F.coalesce(F.median(d), F.lit(1.0))).scalar()
        return pairs.withColumn("similarity", F.exp(-F.greatest(d, F.lit(0.0)) / s))
    r = upper.agg(F.struct(F.min(d).alias("lo"), F.max(d).alias("hi"))).scalar()
    x = pairs.withColumn("_r", r)
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    sim = F.when(lo.isNull(), None).when(F.col("q_pos") == F.col("l_pos"), 1.0).when(hi <= lo, 0.5).otherwise(
        F.least(F.greatest(1 - (d - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))
    return x.withColumn("similarity", sim).drop("_r")


def unordered_pairs(pairs_with_keys: DataFrame, transform: str = "linear", scale=None) -> DataFrame:
    """i < j pairs with both keys known: similarity and ``positive`` = same key."""
    s = to_similarity(pairs_with_keys, transform, scale).filter(F.col("q_pos") < F.col("l_pos"))
    return s.filter(F.col("q_key").isNotNull() & F.col("l_key").isNotNull()).withColumn(
        "positive", F.col("q_key") == F.col("l_key"))


def keyed_sides(spectra: DataFrame, p, key: str, chars: int, fragment_only: bool):
    """(scorer, symmetric, left, right) of the spectra whose key prefix is known, prefixes beside them."""
    from ..functions.distances import is_symmetric

    scorer = Scorer(p, fragment_only=fragment_only)
    s = spectra.withColumn("_key", key_prefix(F.col(key), chars)).filter(F.col("_key").isNotNull())
    extra = ["_key"] + scorer.extra()
    return scorer, is_symmetric(scorer.method, p.ot_method or "exact"), *sides(s, s, scorer.channels(), extra, extra)


def scored_pairs(spectra: DataFrame, p, key: str = "inchikey", chars: int = 14, fragment_only: bool = False,
                 cell: int = 512) -> DataFrame:
    """i < j pairs with both key prefixes known: q_pos, l_pos, distance, positive.

    Same rows as attach_keys + unordered_pairs on a full table, but one triangle of
    cells and no joins: the keys travel with the spectra.
    """
    import numpy as np

    from .blocks import to_table
    from .search import unordered_mask

    scorer, one_way, q, lib = keyed_sides(spectra, p, key, chars, fragment_only)
    schema = "q_pos long, l_pos long, distance double, positive boolean"

    def reduce_cell(lt, rt):
        qp, lp = lt.column("q_pos").to_numpy(), rt.column("l_pos").to_numpy()
        keep = unordered_mask(qp, lp) if one_way else qp[:, None] < lp[None, :]
        rows, cols = np.nonzero(keep)
        d = scorer.distance(lt, rt, keep)
        qk, lk = (np.array(c.to_pylist(), object) for c in (lt.column("q__key"), rt.column("l__key")))
        a, b = qp[rows], lp[cols]
        return to_table(schema, {"q_pos": np.minimum(a, b), "l_pos": np.maximum(a, b), "distance": d[rows, cols],
                                 "positive": (qk[rows] == lk[cols]).astype(bool)})

    return block_apply(q, lib, reduce_cell, schema, cell, upper_only=one_way, scorer=scorer)


def auc_roc(pairs: DataFrame, transform: str = "linear", scale=None, n_spectra: int | None = None) -> DataFrame:
    """AUC of same-key pairs; takes scored_pairs or a table with attached keys.

    ``n_spectra`` is the size of the set, spectra without key included; below 3 there is no AUC and no pair counts.
    """
    if n_spectra is not None and n_spectra < 3:
        return pairs.sparkSession.range(1).select(F.lit(None).cast("double").alias("auc"), F.lit(0).cast("long").alias("n_positive"),
                                                  F.lit(0).cast("long").alias("n_negative"))
    x = to_similarity(pairs, transform, scale) if "positive" in pairs.columns else unordered_pairs(pairs, transform, scale)
    return rank_auc(x, "similarity")


def _auc_row(spark, n_pos: int, n_neg: int, twice: int) -> DataFrame:
    auc = twice / (2 * n_pos * n_neg) if n_pos and n_neg else None
    return spark.createDataFrame([(auc, n_pos, n_neg)], "auc double, n_positive long, n_negative long")


def auc_of_spectra(spectra: DataFrame, p, key: str = "inchikey", chars: int = 14, fragment_only: bool = False,
                   n_spectra: int | None = None) -> DataFrame:
    """``auc_roc`` of ``scored_pairs``, ordered in passes over the pairs (``pair_order``)."""
    from .pair_order import order_counts

    if n_spectra is not None and n_spectra < 3:
        return _auc_row(spectra.sparkSession, 0, 0, 0)
    scorer, one_way, q, lib = keyed_sides(spectra, p, key, chars, fragment_only)
    return _auc_row(spectra.sparkSession, *order_counts(q, lib, scorer, one_way, False))


def similarity_summary(pairs, transforms=TRANSFORMS) -> DataFrame:
    """(transform, mean, low, high) over the i < j pairs of a table or of ``AllPairs``.

    Of ``AllPairs`` each cell adds up what it scores; the scale of ``exponential`` is their exact median.
    """
    import numpy as np

    from ..functions.distances import is_symmetric
    from .pair_order import histogram, middle, pair_values

    if isinstance(pairs, DataFrame) or pairs.repeated():
        k, out = pairs if isinstance(pairs, DataFrame) else pairs.rows(), None
        for t in transforms:
            x = to_similarity(k, t).filter("q_pos < l_pos").agg(F.avg("similarity").alias("mean"), F.min("similarity").alias("low"), F.max("similarity").alias("high"))
            x = x.withColumn("transform", F.lit(t))
            out = x if out is None else out.unionByName(x)
        return out
    scorer, q, lib = pairs.keyed()
    one_way = is_symmetric(scorer.method, pairs.p.ot_method or "exact")
    values = pair_values(scorer, one_way, False)
    q, lib = q.persist(), lib.persist()
    schema = "n long, total double, clamped double, inverse double, lo double, hi double, e double"

    def sums(scale):
        def strip(session, a, x, rights):
            rows = []
            for _, y in rights:
                d = values(x, y)[0]
                low = np.maximum(d, 0)
                rows.append((len(d), d.sum(), np.minimum(low, 1).sum(), (1 / (1 + low)).sum(), d.min(initial=np.inf), d.max(initial=-np.inf),
                             0.0 if scale is None else np.exp(-low / scale).sum()))
            cols = list(zip(*rows))
            yield to_table(schema, {c: [f(v)] for c, f, v in zip(("n", "total", "clamped", "inverse", "lo", "hi", "e"),
                                                                 (sum, sum, sum, sum, min, max, sum), cols)})

        strip.always = True
        return block_apply(q, lib, None, schema, upper_only=one_way, scorer=scorer, strip=strip).agg(
            *[F.sum(c).alias(c) for c in ("n", "total", "clamped", "inverse", "e")], F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()

    scale = None
    if "exponential" in transforms:
        scale = middle(q, lib, scorer, one_way, histogram(q, lib, scorer, values, one_way))
        scale = 1.0 if scale is None else scale
    r = sums(scale)
    q.unpersist(), lib.unpersist()
    n, rows = r["n"] or 0, []
    for t in transforms:
        if not n:
            rows.append((None, None, None, t))
            continue
        lo, hi, clip = r["lo"], r["hi"], lambda v: min(max(v, 0.0), 1.0)
        rows.append((*{
            "linear": lambda: (1 - r["total"] / n, 1 - hi, 1 - lo),
            "linear_clamp": lambda: (1 - r["clamped"] / n, 1 - clip(hi), 1 - clip(lo)),
            "minmax": lambda: (1 - (r["total"] / n - lo) / (hi - lo), 0.0, 1.0) if hi > lo else (0.5, 0.5, 0.5),
            "reciprocal": lambda: (r["inverse"] / n, 1 / (1 + max(hi, 0.0)), 1 / (1 + max(lo, 0.0))),
            "exponential": lambda: (r["e"] / n, float(np.exp(-max(hi, 0.0) / scale)), float(np.exp(-max(lo, 0.0) / scale)))}[t](), t))
    return pairs.spectra.sparkSession.createDataFrame([(*(None if v is None else v if isinstance(v, str) else float(v) for v in x),) for x in rows],
                                                      "mean double, low double, high double, transform string")


def ordered_discrimination(pairs_with_keys) -> DataFrame:
    """AUC over all ordered pairs i != j with linear similarity; takes a table with attached keys or keyed ``AllPairs``."""
    if not isinstance(pairs_with_keys, DataFrame):
        from .pair_order import order_counts

        if not pairs_with_keys.repeated():
            scorer, q, lib = pairs_with_keys.keyed()
            q, lib = q.filter("q__key is not null"), lib.filter("l__key is not null")
            return _auc_row(q.sparkSession, *order_counts(q, lib, scorer, False, True))
        pairs_with_keys = pairs_with_keys.rows()
    p = pairs_with_keys.filter((F.col("q_pos") != F.col("l_pos")) & F.col("q_key").isNotNull()
                               & F.col("l_key").isNotNull())
    return rank_auc(to_similarity(p).withColumn("positive", F.col("q_key") == F.col("l_key")), "similarity")


def fdr_curve(scored: DataFrame, thresholds=FDR_THRESHOLDS, score: str = "similarity",
              positive: str = "positive") -> DataFrame:
    """Matches, true and false positives at or above each threshold; fdr 0 without calls,
    NULL without any pair.  One pass: all thresholds are conditional sums."""
    s, y = F.col(score), F.col(positive)
    aggs = [F.count("*").alias("_n")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if((s >= t) & y).alias(f"_t{i}"), F.count_if((s >= t) & ~y).alias(f"_f{i}")]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("n_true_pos"),
                              F.col(f"_f{i}").alias("n_false_pos")) for i, t in enumerate(thresholds)])
    x = scored.agg(*aggs).select("_n", F.explode(rows).alias("r")).select("_n", "r.*")
    return _fdr_rows(x)


def fdr_of_spectra(spectra: DataFrame, p, thresholds=FDR_THRESHOLDS, key: str = "inchikey", chars: int = 14,
                   fragment_only: bool = False, cell: int = 512) -> DataFrame:
    """``fdr_curve`` of the ``minmax`` similarity of ``scored_pairs``, counted inside the cells.

    Two passes: the range of all distances, then the counts at the thresholds.  No pair leaves its cell.
    """
    import numpy as np

    from .blocks import equal_matrix, to_table
    from .search import unordered_mask

    scorer, one_way, q, lib = keyed_sides(spectra, p, key, chars, fragment_only)

    def scored(lt, rt):
        qp, lp = lt.column("q_pos").to_numpy(), rt.column("l_pos").to_numpy()
        keep = unordered_mask(qp, lp) if one_way else qp[:, None] < lp[None, :]
        same = equal_matrix(lt.column("q__key"), rt.column("l__key"))[0]
        return scorer.distance(lt, rt, keep)[keep], same[keep]

    def extent(lt, rt):
        d = scored(lt, rt)[0]
        d = d[np.isfinite(d)]
        return to_table(ends, {"lo": [d.min(initial=np.inf)], "hi": [d.max(initial=-np.inf)]})

    def widest(t):
        return to_table(ends, {"lo": [t.column("lo").to_numpy().min()], "hi": [t.column("hi").to_numpy().max()]})

    ends = "lo double, hi double"
    r = block_apply(q, lib, extent, ends, cell, upper_only=one_way, merge=widest, scorer=scorer).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    lo, hi = (float("inf"), float("-inf")) if r["lo"] is None else r
    schema = "n long, i long, t long, f long"

    def counts(lt, rt):
        d, same = scored(lt, rt)
        if lo > hi:
            sim = np.full(len(d), -np.inf)  # no finite distance: no similarity passes a threshold
        elif hi <= lo:
            sim = np.full(len(d), 0.5)
        else:
            sim = 1 - (d - lo) / (hi - lo)
            sim = np.where(np.isnan(sim), 1.0, np.clip(sim, 0.0, 1.0))
        hits = [sim >= t for t in thresholds]
        return to_table(schema, {"n": np.full(len(hits), len(d)), "i": np.arange(len(hits)),
                                 "t": [int((h & same).sum()) for h in hits], "f": [int((h & ~same).sum()) for h in hits]})

    found = block_apply(q, lib, counts, schema, cell, upper_only=one_way, merge=fold(["i"], n="sum", t="sum", f="sum"), scorer=scorer)
    found = found.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "t", "f")])
    # one row per threshold
    grid = spectra.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(thresholds)], "i long, threshold double")
    zero = F.lit(0).cast("long")
    return _fdr_rows(grid.join(found, "i", "left").select(
        F.coalesce("n", zero).alias("_n"), "threshold", F.coalesce("t", zero).alias("n_true_pos"), F.coalesce("f", zero).alias("n_false_pos")))


def _fdr_rows(x: DataFrame) -> DataFrame:
    n = F.col("n_true_pos") + F.col("n_false_pos")
    return x.select("threshold", n.alias("n_matches"), "n_true_pos", "n_false_pos",
                    F.when(F.col("_n") == 0, None).when(n > 0, F.col("n_false_pos") / n)
                    .otherwise(0.0).alias("fdr"))


# --- tie-aware statistics ------------------------------------------------------

def tie_aware_queries(ranked: DataFrame, k_values=(1, 5, 10)) -> DataFrame:
    """Per query first-relevant metrics under three tie rules.

    Input (q_pos, distance, relevant) of finite candidates.  Equal distances form a
    block; the block of the first relevant entry has ``before`` entries ahead of it,
    ``size`` entries and ``hits`` relevant ones.  Optimistic counts it first,
    pessimistic last, fractional averages over random orders of the block.
    """
    before, size, hits = F.col("before"), F.col("size"), F.col("hits")
    best, worst = before + 1, before + size - hits + 1
    cols = [F.col("q_pos"), best.alias("best_rank"), worst.alias("worst_rank"),
            (1.0 / best).alias("rr_optimistic"), (1.0 / worst).alias("rr_pessimistic"),
            expected_reciprocal(before, size, hits).alias("rr_fractional")]
    for k in k_values:
        cols += [(best <= k).cast("double").alias(f"top{k}_optimistic"),
                 (worst <= k).cast("double").alias(f"top{k}_pessimistic"),
                 chance_within(k, before, size, hits).alias(f"top{k}_fractional")]
    return first_relevant(ranked).select(*cols)


def tie_aware_precision(ranked: DataFrame, n_relevant: DataFrame | None = None, k_values=(1, 5, 10)) -> DataFrame:
    """Expected P@k and AP when equal distances are ordered at random.

    Inside a block of size n with h relevant entries, ``before`` ahead of it and
    ``rel_before`` relevant so far, position j (1-based) is relevant with chance h/n and
    then expects rel_before + 1 + (j-1)(h-1)/(n-1) relevant entries up to itself.
    """
    blocks = ranked.groupBy("q_pos", "distance").agg(F.count("*").alias("n"), F.count_if("relevant").alias("h"))
    w = Window.partitionBy("q_pos").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.withColumns({"before": F.coalesce(F.sum("n").over(w), F.lit(0)),
                            "rel_before": F.coalesce(F.sum("h").over(w), F.lit(0))})
    other = F.when(F.col("n") > 1, (F.col("h") - 1) / (F.col("n") - 1)).otherwise(0.0)
    # (rel_before + 1 + (j - 1) other) / (before + j) is other + rest / (before + j)
    rest = F.col("rel_before") + 1 - other * (F.col("before") + 1)
    ap = F.col("h") * other + F.col("h") / F.col("n") * rest * harmonic(F.col("before"), F.col("n"))
    inside = {k: F.greatest(F.lit(0), F.least(F.col("n"), F.lit(k) - F.col("before"))) for k in k_values}
    per = b.withColumn("_ap", F.when(F.col("h") > 0, ap).otherwise(0.0)).groupBy("q_pos").agg(
        F.sum("_ap").alias("_ap"), F.sum("h").alias("_h"), F.sum("n").alias("_n"),
        *[F.sum(inside[k] * F.col("h") / F.col("n")).alias(f"_e{k}") for k in k_values])
    den = F.col("_h")
    if n_relevant is not None:
        per, den = per.join(n_relevant, "q_pos"), F.col("n_relevant")
    return per.filter(den > 0).select(
        "q_pos", (F.col("_ap") / den).alias("average_precision"),
        *[(F.col(f"_e{k}") / F.least(F.lit(k), F.col("_n"))).alias(f"p_at_{k}") for k in k_values])


def tie_diagnostics(ranked: DataFrame) -> DataFrame:
    """Per query: candidates, distinct distances, largest tie, best-distance tie size."""
    blocks = ranked.groupBy("q_pos", "distance").agg(F.count("*").alias("n"))
    return blocks.groupBy("q_pos").agg(
        F.sum("n").alias("n_candidates"), F.count("*").alias("n_distinct"),
        F.max("n").alias("largest_tie"), F.min_by("n", "distance").alias("best_tie"))


def single_target_metrics(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Rank metrics of one target per query under random ties; NULL if any distance of the
    query is not finite.  ``targets`` is (q_pos, l_pos)."""
    t = ranked.join(targets.select("q_pos", F.col("l_pos").alias("_t")), "q_pos")
    own = t.groupBy("q_pos").agg(
        F.max(F.when(F.col("l_pos") == F.col("_t"), F.col("distance"))).alias("own"),
        F.min(is_finite(F.col("distance"))).alias("finite"))
    c = t.join(own, "q_pos").groupBy("q_pos", "finite").agg(
        F.count_if(F.col("distance") < F.col("own")).alias("closer"),
        F.count_if(F.col("distance") == F.col("own")).alias("tied"))
    best, ties = F.col("closer") + 1, F.col("tied")
    rr = harmonic(F.col("closer"), ties) / ties
    ok = F.col("finite") & (ties > 0)
    return c.select("q_pos", F.when(ok, best).alias("best_rank"),
                    F.when(ok, best + ties - 1).alias("worst_rank"),
                    F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (2 - best) / ties))).alias("top1_fractional"),
                    F.when(ok, rr).alias("rr_fractional"))


# --- agreement of labelings ------------------------------------------------------

def contingency(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))


def nmi_ari(df: DataFrame, truth: str, predicted: str, drop_noise: bool = True) -> DataFrame:
    """2*MI/(H+H) with natural logs (0 if both entropies are 0) and the adjusted Rand index."""
    if drop_noise:
        df = df.filter(F.col(predicted).cast("string") != "0")
    c = contingency(df, truth, predicted)
    rows = c.groupBy("t").agg(F.sum("n").alias("nt"))
    cols = c.groupBy("p").agg(F.sum("n").alias("np"))
    total = c.agg(F.sum("n")).scalar()
    rows, cols = rows.withColumn("_n", total), cols.withColumn("_n", total)
    n = F.col("_n")

    def pairs2(x):
        return x.cast("double") * (x - 1) / 2

    def entropy(x):
        return -F.sum((x / n) * F.log(x / n))

    joint = c.join(rows, "t").join(cols.drop("_n"), "p")
    mi = joint.agg(F.struct(
        F.sum(F.col("n") / n * F.log(F.col("n") * n / (F.col("nt") * F.col("np")))).alias("mi"),
        F.sum(pairs2(F.col("n"))).alias("ij"))).scalar()
    ht = rows.agg(F.struct(entropy(F.col("nt")).alias("h"), F.sum(pairs2(F.col("nt"))).alias("s"))).scalar()
    out = cols.agg(entropy(F.col("np")).alias("hp"), F.sum(pairs2(F.col("np"))).alias("sp"),
                   F.sum("np").alias("n")).withColumn("mi", mi).withColumn("ht", ht)
    expected = F.col("ht.s") * F.col("sp") / pairs2(F.col("n"))
    top = (F.col("ht.s") + F.col("sp")) / 2
    hsum = F.col("ht.h") + F.col("hp")
    return out.select(
        F.when(hsum > 0, 2 * F.col("mi.mi") / hsum).otherwise(0.0).alias("nmi"),
        F.when(F.abs(top - expected) > 0, (F.col("mi.ij") - expected) / (top - expected)).otherwise(0.0).alias("ari"),
        F.col("n").alias("n"))


def silhouette(spectra: DataFrame, p, label: str, fragment_only: bool = False, cell: int = 512) -> DataFrame:
    """Silhouette width per spectrum; a lone member of its class scores 0.

    Missing, empty and ``unclassified`` labels take no part; below 10 spectra or 2 classes the width is NULL.

    Cells reduce to one distance sum per (query, class), so the shuffle is
    queries x classes x blocks rather than all pairs.
    """
    import numpy as np

    from .blocks import to_table

    scorer = Scorer(p, fragment_only=fragment_only)
    s = spectra.withColumn("_cls", F.col(label).cast("string")).filter("_cls is not null and _cls not in ('', 'unclassified')")
    q, lib = sides(s, s, scorer.channels(), ["_cls"] + scorer.extra(), ["_cls"] + scorer.extra())
    schema = "query_id string, q_pos long, own string, cls string, total double, n long"

    def reduce_cell(lt, rt):
        d = scorer.distance(lt, rt)
        qp, lp = lt.column("q_pos").to_numpy(), rt.column("l_pos").to_numpy()
        keep = qp[:, None] != lp[None, :]
        names, code = np.unique(np.array(rt.column("l__cls").to_pylist(), object).astype(str), return_inverse=True)
        hot = np.zeros((len(lp), len(names)))
        hot[np.arange(len(lp)), code] = 1
        total, n = np.where(keep, d, 0.0) @ hot, keep.astype(float) @ hot
        i, k = np.nonzero(n > 0)
        own = np.array(lt.column("q__cls").to_pylist(), object)
        ids = np.array(lt.column("query_id").to_pylist(), object)
        return to_table(schema, {"query_id": list(ids[i]), "q_pos": qp[i], "own": list(own[i]),
                                 "cls": list(names[k]), "total": total[i, k], "n": n[i, k].astype(np.int64)})

    merge = fold(["query_id", "q_pos", "own", "cls"], total="sum", n="sum")
    sums = (block_apply(q, lib, reduce_cell, schema, cell, merge=merge, scorer=scorer).groupBy("query_id", "q_pos", "own", "cls")
            .agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
    mean = F.col("total") / F.col("n")
    same = F.col("own") == F.col("cls")
    ab = sums.groupBy("query_id", "q_pos", "own").agg(
        F.max(F.when(same, mean)).alias("a"), F.min(F.when(~same, mean)).alias("b"))
    a, b = F.col("a"), F.col("b")
    enough = s.agg((F.count("*") >= 10) & (F.countDistinct("_cls") >= 2)).scalar()
    width = F.when(~enough, F.lit(None)).when(a.isNull() | b.isNull(), 0.0).when(F.greatest(a, b) == 0, 0.0).otherwise(
        (b - a) / F.greatest(a, b))
    return ab.select("query_id", F.col("own").alias("label"), width.alias("silhouette"))


def homolog_detection(spectra: DataFrame, p, similarity: float = 0.5, ri_gap: float = 50.0,
                      label: str = "compound_class", fragment_only: bool = False) -> DataFrame:
    """Pairs with similarity strictly above the limit whose RI differs by more than the gap;
    score = share of them with the same class."""
    import numpy as np

    from ..functions.distances import is_symmetric
    from .blocks import _values, equal_matrix, to_table
    from .search import unordered_mask

    scorer = Scorer(p, fragment_only=fragment_only)
    one_way = is_symmetric(scorer.method, p.ot_method or "exact")
    s = spectra.withColumn("_cls", F.col(label).cast("string"))
    extra = ["ri", "_cls"] + scorer.extra()
    q, lib = sides(s, s, scorer.channels(), extra, extra)
    schema = "n long, t long"

    def reduce_cell(lt, rt):
        qp, lp = lt.column("q_pos").to_numpy(), rt.column("l_pos").to_numpy()
        mask = unordered_mask(qp, lp) if one_way else qp[:, None] < lp[None, :]
        with np.errstate(invalid="ignore"):
            mask = mask & (np.abs(_values(lt, "q_ri")[:, None] - _values(rt, "l_ri")[None, :]) > ri_gap)
        hit = mask & (scorer.distance(lt, rt, mask) < 1.0 - similarity)
        same, missing = equal_matrix(lt.column("q__cls"), rt.column("l__cls"))
        return to_table(schema, {"n": [int(hit.sum())], "t": [int((hit & same & ~missing).sum())]})

    def merge(t):
        return to_table(schema, {c: [t.column(c).to_numpy().sum()] for c in ("n", "t")})

    out = block_apply(q, lib, reduce_cell, schema, upper_only=one_way, merge=merge, scorer=scorer).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_true"))
    return out.withColumn("homolog_score", F.when(F.col("n_pairs") > 0, F.col("n_true") / F.col("n_pairs")).otherwise(0.0))


def homolog_ground_truth(spectra: DataFrame, key: str = "inchikey", min_size: int = 3, chars: int = 14) -> DataFrame:
    """(id, group) of key-prefix groups with at least ``min_size`` members."""
    s = spectra.select("id", key_prefix(F.col(key), chars).alias("group")).filter(F.col("group").isNotNull())
    big = s.groupBy("group").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_size)
    return s.join(big.select("group"), "group", "left_semi")


def topk_accuracy(hits: DataFrame, truth: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """Share of queries with a same-group entry among their first k; queries without
    truth or candidates leave the denominator."""
    if exclude_self:
        hits = hits.filter(F.col("query_id") != F.col("library_id"))
        w = Window.partitionBy("query_id").orderBy("rank")
        hits = hits.withColumn("rank", F.row_number().over(w))
    g = truth.select("id", "group")
    x = (hits.filter(F.col("rank") <= k).join(g.toDF("query_id", "q_group"), "query_id")
         .join(g.toDF("library_id", "l_group"), "library_id", "left"))
    per = x.groupBy("query_id").agg(F.max(F.coalesce(
        (F.col("q_group") == F.col("l_group")), F.lit(False)).cast("double")).alias("hit"))
    return per.agg(F.avg("hit").alias("accuracy"), F.count("*").alias("n_queries"))


def confusion(df: DataFrame, truth: str, predicted: str, levels) -> DataFrame:
    """Long confusion table with every level combination."""
    seen = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(a, b) for a in levels for b in levels], "truth string, predicted string")
    return grid.join(seen, ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def recall_per_class(table: DataFrame) -> DataFrame:
    return table.groupBy("truth").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n"))
                                                  .otherwise(0)).cast("double"), F.sum("n")).alias("recall"))


def accuracy(table: DataFrame) -> DataFrame:
    return table.agg(F.try_divide(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
                                  .cast("double"), F.sum("n")).alias("accuracy"))
