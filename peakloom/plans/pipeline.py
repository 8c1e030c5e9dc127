"""End-to-end run: feature table to spectra, similarity, clusters and reports."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, deriv, explain, layout, quant, search, similarity
from ..operators.spectra import build_spectra, class_summary, class_summary_simple, functional_group_counts, spread
from ..sources.msdial import FeatureTable, read_ms_dial


@dataclass(frozen=True)
class RunOptions:
    """Switches of a full run; unknown names are refused by ``options``."""

    blank_factor: float = 3.0
    nonzero_ratio: float = 0.2
    deduplicate: bool = True
    cluster: bool = True
    embed: bool = True
    explain: bool = True
    reports: bool = True
    top_within: int = 5
    top_outside: int = 3
    derivatization_truth: str | None = None


def options(**given) -> RunOptions:
    known = {f.name for f in fields(RunOptions)}
    bad = [k for k in given if k not in known]
    if bad:
        raise ValueError(f"unknown option(s): {', '.join(bad)}")
    return RunOptions(**given)


def run_similarity(spark: SparkSession, source, p, out_dir: str | None = None, **given) -> dict:
    """Returns named DataFrames; with ``out_dir`` every one is also written.

    Built spectra are written once (Parquet) and read back, so the later all-pairs
    stages start from a short lineage and survive lost executors.
    """
    o = options(**given)
    p = p.validate()
    table = source if isinstance(source, FeatureTable) else read_ms_dial(spark, source)
    q = quant.prepare_quant_data(table, p, o.blank_factor, o.nonzero_ratio, deduplicate=o.deduplicate)
    spectra = build_spectra(spread(quant.build_df_spec(table, q.final), "pos"), p)
    if out_dir:
        spectra.write.mode("overwrite").parquet(f"{out_dir}/spectra")
        spectra = spark.read.parquet(f"{out_dir}/spectra")
    else:
        spectra = spectra.persist()
    out = {"final": q.final, "spectra": spectra, "class_summary": class_summary(spectra),
           "class_summary_simple": class_summary_simple(spectra), "functional_groups": functional_group_counts(spectra)}
    if o.derivatization_truth:
        for k, v in deriv.run_evaluation(spectra, o.derivatization_truth).items():
            out[f"derivatization_{k}"] = v
    out["similarity"] = similarity.similarity_table(spectra, p, components=p.return_distance_components)
    out["analog_graph"] = similarity.analog_graph(spectra, p)
    labelled = spectra
    if o.cluster:
        out["clusters"] = clustering.cluster_density(spectra, p)
        labelled = spectra.join(out["clusters"].select("pos", "cluster"), "pos").persist()
    if o.embed:
        out["coordinates"] = layout.embed(spectra, p)
    if o.cluster and o.explain:
        notes = explain.annotate_clusters(labelled, p)
        out["cluster_membership"], out["cluster_drivers"] = notes["membership"], notes["cluster_summary"]
        if notes["typical_loss_long"] is not None:
            out["cluster_motifs"] = notes["typical_loss_long"]
        if o.reports:
            members = labelled.filter("cluster <> '0'")
            med = explain.medoids(explain.within_cluster_sums(members, p))
            partners = explain.medoid_partners(labelled, p, med, o.top_within, o.top_outside)
            pairs = partners.select(F.col("medoid_id").alias("query_id"), "q_pos", F.col("partner_id").alias("library_id"), "l_pos", "kind")
            detail = explain.pair_breakdown(pairs, labelled, labelled, p)
            out["medoid_partners"], out["pair_breakdown"] = partners, detail
            out["reports"] = explain.cluster_reports(notes["cluster_summary"], partners, detail)
    if out_dir:
        write_outputs(out, out_dir)
    return out


def write_outputs(frames: dict, out_dir: str) -> None:
    """Flat tables as CSV, anything with nested columns as Parquet."""
    for name, df in frames.items():
        if name == "spectra":
            continue
        nested = any("array" in t or "struct" in t or "map" in t for _, t in df.dtypes)
        w = df.drop("_part").write.mode("overwrite")
        (w.parquet if nested else w.option("header", True).csv)(f"{out_dir}/{name}")


def to_wide(table: DataFrame, value: str, max_cells: int = 1_000_000) -> DataFrame:
    """Square matrix form for small exports; refuses more than ``max_cells``."""
    n = table.select("q_pos").distinct().count()
    m = table.select("l_pos").distinct().count()
    if n * m > max_cells:
        raise ValueError(f"a wide export of {n} x {m} exceeds {max_cells} cells")
    return table.groupBy("query_id").pivot("library_id").agg(F.first(value))


def library_run(spark: SparkSession, query_path: str, library_path: str, p, top_n: int = 10,
                ri_tolerance: float | None = None) -> DataFrame:
    """MSP query file against MSP library file."""
    from ..sources.msp import build_spectra_from_msp
    q, lib = build_spectra_from_msp(spark, query_path, p), build_spectra_from_msp(spark, library_path, p)
    return search.search_library(q, lib, p, top_n, ri_tolerance, metadata=("name", "inchikey", "formula", "ri"))
