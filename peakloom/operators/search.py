"""Library search, two-stage reranking and full distance tables."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distances as D
from ..functions.ragged import Batch
from .blocks import (CELL, HIT_SCHEMA, Scorer, _column, _values, block_apply, empty_table, fold,
                     hits_table, into_bands, nearest, rank_hits, same_id_mask, sides, to_table)


def ri_gate(tolerance: float):
    """Pairs whose retention indices are both present and within ``tolerance``."""
    def gate(lt, rt):
        q, r = _values(lt, "q_ri"), _values(rt, "l_ri")
        with np.errstate(invalid="ignore"):
            return np.abs(q[:, None] - r[None, :]) <= tolerance
    return gate


def ri_bands(queries: DataFrame, library: DataFrame, tolerance: float):
    """Bucket both sides so that every pair within ``tolerance`` meets exactly once."""
    q, lib = queries.filter(F.col("ri").isNotNull()), library.filter(F.col("ri").isNotNull())
    return into_bands(q, lib, F.col("ri"), max(float(tolerance) * (1 + 1e-9), 1e-9))


def search_library(queries: DataFrame, library: DataFrame, p, top_n: int = 10,
                   ri_tolerance: float | None = None, metadata=(), exclude_self: bool = False,
                   fragment_only: bool = False, cell: int = CELL) -> DataFrame:
    """Best ``top_n`` library entries per query by similarity = 1 - distance.

    With an RI tolerance only pairs with both indices present and close enough are
    scored; if either side has no ``ri`` column the tolerance is ignored.
    """
    scorer = Scorer(p, fragment_only=fragment_only)
    has_ri = "ri" in queries.columns and "ri" in library.columns
    if ri_tolerance is not None and has_ri:
        q, lib = ri_bands(queries, library, ri_tolerance)
        hits = nearest(q, lib, scorer, top_n, exclude_self, ri_gate(ri_tolerance), ("ri",), "band", cell)
    else:
        hits = nearest(queries, library, scorer, top_n, exclude_self, cell=cell)
    sim = 1 - F.least(F.greatest(F.col("distance"), F.lit(0.0)), F.lit(1.0))
    hits = hits.withColumn("similarity", sim)
    keep = [c for c in metadata if c in library.columns]
    lib_cols = [F.col("pos").cast("long").alias("l_pos"), *[F.col(c) for c in keep if c != "ri"]]
    if has_ri:
        lib_cols.append(F.col("ri").alias("ri"))
    if len(lib_cols) > 1:
        hits = hits.join(library.select(*lib_cols), "l_pos", "left")
    if has_ri:
        hits = hits.join(queries.select(F.col("pos").cast("long").alias("q_pos"), F.col("ri").alias("_qri")),
                         "q_pos", "left").withColumn("delta_ri", F.abs(F.col("_qri") - F.col("ri")))
    out = ["query_id", "rank", "library_id", "similarity"]
    out += (["delta_ri"] if has_ri else []) + [c for c in keep if c != "ri"]
    out += ["ri"] if has_ri and "ri" in metadata else []
    return hits.select(*out)


def check_rerank(p, first_pass_top_k, final_top_k, first_method, rerank_method):
    D.check_method(first_method)
    D.check_method(rerank_method)
    if p.use_split_loss:
        raise ValueError("two-stage search does not support split derived channels")
    if first_pass_top_k < 1 or final_top_k < 1:
        raise ValueError("top-k values must be >= 1")
    if final_top_k > first_pass_top_k:
        raise ValueError("final_top_k must be <= first_pass_top_k")


def search_topk_rerank(queries: DataFrame, library: DataFrame, p, first_pass_method="entropy_weighted",
                       rerank_method="ppm_wasserstein", first_pass_top_k: int = 50, final_top_k: int = 10,
                       exclude_self: bool | None = None, fragment_only: bool = False, gate=None,
                       gate_columns=(), bucket: str | None = None, cell: int = CELL) -> DataFrame:
    """Cheap method over the library, then an expensive method on the survivors.

    Returns query_id, rank, library_id, distance, first_pass_distance,
    first_pass_rank.  Survivors (k per query) are joined back to their peaks.  By
    default a set searched against itself leaves out each query's own entry.
    """
    if exclude_self is None:
        exclude_self = queries.sameSemantics(library)
    check_rerank(p, first_pass_top_k, final_top_k, first_pass_method, rerank_method)
    if fragment_only:
        p = p.with_(w_frag=1.0, w_loss=0.0)
    stage1 = nearest(queries, library, Scorer(p, first_pass_method, fragment_only), first_pass_top_k,
                     exclude_self, gate, gate_columns, bucket, cell)
    # banded queries appear once per band
    q_rows = queries if bucket is None else queries.dropDuplicates(["pos"])
    return rerank(stage1, q_rows, library, p, first_pass_method, rerank_method, final_top_k, fragment_only)


def rerank(stage1: DataFrame, queries: DataFrame, library: DataFrame, p, first_pass_method, rerank_method,
           final_top_k: int, fragment_only: bool = False) -> DataFrame:
    """Score ranked first-pass hits by the second method; every query row appears once in ``queries``."""
    if first_pass_method == rerank_method:
        scored = stage1.withColumn("first_pass_distance", F.col("distance")).withColumn(
            "first_pass_rank", F.col("rank"))
    else:
        cand = stage1.select("query_id", "q_pos", "library_id", "l_pos",
                             F.col("distance").alias("first_pass_distance"),
                             F.col("rank").alias("first_pass_rank"))
        scored = score_pairs(cand, queries, library, Scorer(p, rerank_method, fragment_only))
    return rank_hits(scored.drop("rank"), final_top_k).select(
        "query_id", "q_pos", "rank", "library_id", "l_pos", "distance", "first_pass_distance",
        "first_pass_rank")


def candidate_summary(queries: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Rows returned per query, with a flag where fewer than ``k`` came back."""
    n = results.groupBy("query_id").agg(F.count("*").alias("n_returned"))
    return (queries.select(F.col("id").cast("string").alias("query_id")).join(n, "query_id", "left")
            .withColumn("n_returned", F.coalesce("n_returned", F.lit(0)))
            .withColumn("short", F.col("n_returned") < k))


def score_pairs(pairs: DataFrame, queries: DataFrame, library: DataFrame, scorer: Scorer) -> DataFrame:
    """Score an explicit pair list (query_id, q_pos, library_id, l_pos, ...)."""
    ch, extra = scorer.channels(), scorer.extra()
    q = queries.select(F.col("pos").cast("long").alias("q_pos"), *[F.col(c).alias(f"a_{c}") for c in ch],
                       *[F.col(c).alias(f"q_{c}") for c in extra])
    lib = library.select(F.col("pos").cast("long").alias("l_pos"), *[F.col(c).alias(f"b_{c}") for c in ch],
                         *[F.col(c).alias(f"l_{c}") for c in extra])
    joined = pairs.join(q, "q_pos").join(lib, "l_pos")
    keep = pairs.columns
    schema = pairs.select(*keep).withColumn("distance", F.lit(0.0)).schema

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            t = pa.Table.from_batches([batch])
            out = t.select(keep)
            yield out.append_column("distance", pa.array(pair_components(t, scorer)["distance"])) \
                .combine_chunks().to_batches(max_chunksize=max(1, t.num_rows))[0] if t.num_rows else \
                out.append_column("distance", pa.array([], pa.float64())).to_batches()[0]

    return joined.mapInArrow(run, schema)


def pair_components(t, scorer: Scorer) -> dict:
    """Components of aligned rows: row k of the left side against row k of the right.

    Each pair is a 1 x 1 block for the combination rules, evaluated all at once.
    """
    n, p = t.num_rows, scorer.p
    a = {c: Batch.from_arrow(_column(t, f"a_{c}")) for c in scorer.channels()}
    b = {c: Batch.from_arrow(_column(t, f"b_{c}")) for c in scorer.channels()}
    rows = np.arange(n)
    if scorer.fragment_only:
        return {"distance": np.round(D.pair_distances(a["frag"], b["frag"], rows, rows, scorer.method, p), 13)}
    conf = None
    if scorer.extra():
        conf = (_values(t, "q_mref_confidence"), _values(t, "l_mref_confidence"))
    out = D.combine_rows(a, b, scorer.method, p, conf)
    out["distance"] = np.round(out["distance"], 13)
    return out


class AllPairs:
    """Every pair of one set of spectra, or of two, that metrics reduce without a row per pair.

    ``rows()`` is the table itself.  ``ri_tolerance`` keeps pairs whose retention indices are both present and that close.
    """

    def __init__(self, spectra: DataFrame, p, library: DataFrame | None = None, fragment_only: bool = False, ri_tolerance: float | None = None):
        self.spectra, self.p, self.library, self.fragment_only, self.ri_tolerance = spectra, p, library, fragment_only, ri_tolerance
        self.labels = None

    def with_keys(self, labels: DataFrame, library_labels: DataFrame | None = None) -> "AllPairs":
        out = AllPairs(self.spectra, self.p, self.library, self.fragment_only, self.ri_tolerance)
        out.labels = labels, labels if library_labels is None else library_labels
        return out

    def repeated(self) -> bool:
        """True when two rows of a side have one position: their pairs are not told apart by position then."""
        return any(not x.groupBy("pos").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
                   for x in ([self.spectra] if self.library is None else [self.spectra, self.library]))

    def keyed(self, q_extra=(), l_extra=()):
        """(scorer, left, right): both sides of the block join, keys in ``q__key`` and ``l__key``."""
        scorer = Scorer(self.p, fragment_only=self.fragment_only)
        both = [self.spectra, self.spectra if self.library is None else self.library]
        if self.labels is not None:
            both = [x.join(keys.select("pos", F.col("key").alias("_key")), "pos", "left") for x, keys in zip(both, self.labels)]
        extra = (["_key"] if self.labels is not None else []) + (["ri"] if self.ri_tolerance is not None else []) + scorer.extra()
        return scorer, *sides(*both, scorer.channels(), [*extra, *q_extra], [*extra, *l_extra])

    def usable(self):
        """usable(x, right tiles): matrix, true where a pair is not of one position (one set), and inside the RI window."""
        square, tolerance = self.library is None, self.ri_tolerance

        def usable(x, rights):
            l_pos = np.concatenate([y.column("l_pos").to_numpy() for y in rights])
            keep = x.column("q_pos").to_numpy()[:, None] != l_pos[None, :] if square else np.ones((x.num_rows, len(l_pos)), bool)
            if tolerance is None:
                return keep
            with np.errstate(invalid="ignore"):
                return keep & (np.abs(_values(x, "q_ri")[:, None] - np.concatenate([_values(y, "l_ri") for y in rights])[None, :]) <= tolerance)

        return usable

    def rows(self) -> DataFrame:
        from .metrics import attach_keys
        if self.library is None:
            d = distance_table(self.spectra, self.p, fragment_only=self.fragment_only)
        else:
            scorer, k = Scorer(self.p, fragment_only=self.fragment_only), self.library.count()
            if self.ri_tolerance is None:
                d = nearest(self.spectra, self.library, scorer, k)
            else:
                q, lib = ri_bands(self.spectra, self.library, self.ri_tolerance)
                d = nearest(q, lib, scorer, k, gate=ri_gate(self.ri_tolerance), gate_columns=("ri",), bucket="band")
        return d if self.labels is None else attach_keys(d, *self.labels)


def distance_table(spectra: DataFrame, p, library: DataFrame | None = None, fragment_only: bool = False,
                   components: bool = False, max_cells: int | None = None, cell: int = CELL) -> DataFrame:
    """Every distance, long form: query_id, q_pos, library_id, l_pos, distance, ...

    The output is quadratic by definition; ``max_cells`` refuses larger requests.  A
    square table of a symmetric method scores one triangle and mirrors it, and its
    diagonal is 0.
    """
    square = library is None
    lib = spectra if square else library
    if max_cells is not None and spectra.count() * lib.count() > max_cells:
        raise ValueError(f"distance table would exceed {max_cells} cells; use a top-k search")
    scorer = Scorer(p, fragment_only=fragment_only)
    q, r = sides(spectra, lib, scorer.channels(), scorer.extra(), scorer.extra())
    one_way = square and D.is_symmetric(scorer.method, p.ot_method or "exact")
    names = component_names(p) if components else []
    schema = HIT_SCHEMA + "".join(f", {n} double" for n in names)

    def reduce_cell(lt, rt):
        qp, lp = lt.column("q_pos").to_numpy(), rt.column("l_pos").to_numpy()
        if one_way:
            keep = unordered_mask(qp, lp)
        else:
            keep = (qp[:, None] != lp[None, :]) if square else np.ones((len(qp), len(lp)), bool)
        comp = scorer.components(lt, rt, keep)
        if components:
            comp.update(D.contributions(comp, p))
        rows, cols = np.nonzero(keep)
        out = hits_table(lt, rt, comp["distance"], rows, cols)
        cols_out = {f: out.column(f).combine_chunks() for f in out.column_names}
        for n in names:
            cols_out[n] = comp[n][rows, cols] if n in comp else np.full(len(rows), np.nan)
        return to_table(schema, cols_out)

    out = block_apply(q, r, reduce_cell, schema, cell, upper_only=one_way, scorer=scorer)
    if square:
        if one_way:
            out = out.unionByName(out.select(
                F.col("library_id").alias("query_id"), F.col("l_pos").alias("q_pos"),
                F.col("query_id").alias("library_id"), F.col("q_pos").alias("l_pos"),
                "distance", *names))
        diag = q.select("query_id", "q_pos", F.col("query_id").alias("library_id"),
                        F.col("q_pos").alias("l_pos"), F.lit(0.0).alias("distance"),
                        *[F.lit(0.0).alias(n) for n in names])
        out = out.unionByName(diag)
    return out


def unordered_mask(qp, lp):
    """Pairs of a block-triangle cell: every pair of two different blocks, and the
    upper triangle where a block meets itself (both sides then hold the same rows)."""
    if np.isin(qp, lp).any():
        return qp[:, None] < lp[None, :]
    return np.ones((len(qp), len(lp)), bool)


def component_names(p) -> list:
    out = ["d_frag", "d_loss", "c_frag_total", "c_loss_total"]
    if p.use_split_loss:
        out += ["d_anchor", "d_anchor_raw", "d_pair", "d_pair_raw", "w_anchor_final", "w_pair_final",
                "w_anchor_typical", "w_pair_typical", "c_anchor_in_loss", "c_pair_in_loss"]
        if p.use_typical_loss:
            out += ["d_anchor_typ", "d_pair_typ", "c_anchor_typ_in_anchor", "c_pair_typ_in_pair"]
    else:
        out += ["d_loss_raw", "w_loss_typical", "w_loss_raw"]
        if p.use_typical_loss:
            out += ["d_loss_typ", "c_loss_typ_in_loss"]
    return out + (["conf_pair"] if p.use_mref_confidence else [])


def pairs_within(spectra: DataFrame, p, max_distance: float, fragment_only: bool = False,
                 columns=(), cell: int = CELL) -> DataFrame:
    """Unordered pairs (q_pos < l_pos) with distance strictly below ``max_distance``."""
    scorer = Scorer(p, fragment_only=fragment_only)
    one_way = D.is_symmetric(scorer.method, p.ot_method or "exact")
    q, r = sides(spectra, spectra, scorer.channels(), scorer.extra(), scorer.extra())

    def reduce_cell(lt, rt):
        qp, lp = lt.column("q_pos").to_numpy(), rt.column("l_pos").to_numpy()
        mask = unordered_mask(qp, lp) if one_way else qp[:, None] < lp[None, :]
        if not mask.any():
            return empty_table(HIT_SCHEMA)
        d = scorer.distance(lt, rt, mask)
        rows, cols = np.nonzero(mask & (d < max_distance))
        return hits_table(lt, rt, d, rows, cols)

    out = block_apply(q, r, reduce_cell, HIT_SCHEMA, cell, upper_only=one_way, scorer=scorer)
    swap = F.col("q_pos") > F.col("l_pos")
    return out.select(
        F.when(swap, F.col("library_id")).otherwise(F.col("query_id")).alias("query_id"),
        F.least("q_pos", "l_pos").alias("q_pos"),
        F.when(swap, F.col("query_id")).otherwise(F.col("library_id")).alias("library_id"),
        F.greatest("q_pos", "l_pos").alias("l_pos"), "distance")


def row_profile(spectra: DataFrame, p, library: DataFrame | None = None, fragment_only: bool = False,
                cell: int = CELL) -> DataFrame:
    """Per query: count, sum, minimum and maximum distance over the library (self
    excluded in the square case), reduced inside the cells before the shuffle."""
    square = library is None
    scorer = Scorer(p, fragment_only=fragment_only)
    q, r = sides(spectra, spectra if square else library, scorer.channels(), scorer.extra(), scorer.extra())
    schema = "query_id string, q_pos long, n long, total double, low double, high double"

    def reduce_cell(lt, rt):
        d = scorer.distance(lt, rt)
        ok = np.isfinite(d)
        if square:
            ok &= lt.column("q_pos").to_numpy()[:, None] != rt.column("l_pos").to_numpy()[None, :]
        return to_table(schema, {
            "query_id": lt.column("query_id").combine_chunks(), "q_pos": lt.column("q_pos").combine_chunks(),
            "n": ok.sum(1), "total": np.where(ok, d, 0.0).sum(1),
            "low": np.where(ok, d, np.inf).min(1), "high": np.where(ok, d, -np.inf).max(1)})

    merge = fold(["query_id", "q_pos"], n="sum", total="sum", low="min", high="max")
    return (block_apply(q, r, reduce_cell, schema, cell, merge=merge, scorer=scorer).groupBy("query_id", "q_pos")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"),
                 F.max("high").alias("high"))
            .withColumn("mean_distance", F.col("total") / F.col("n")))


def warn_if_short(summary: DataFrame) -> None:
    short = summary.filter("short").count()
    if short:
        warnings.warn(f"{short} queries returned fewer candidates than requested", stacklevel=2)
