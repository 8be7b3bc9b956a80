"""The whole of the engine, from files to files: clustering, then a single pass or a refinement."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import clusters, counts, diagnostics, noise, propagate, refine, reports, runlog, similarity
from ..sources import readers, sinks
from ..sources.tables import saved

log = logging.getLogger("pairwell")


@dataclass
class Outcome:
    """What a run leaves; labels is None if propagation was left out."""

    pairs: DataFrame
    params: DataFrame
    tested: DataFrame
    labels: DataFrame | None
    index: DataFrame
    metrics: list[dict]
    similarity: DataFrame
    coverage: DataFrame


def cluster_file(spark: SparkSession, fasta: str, out: str, *, threshold: float = 0.6, least: int = 1) -> dict:
    """Cluster the sequences of a FASTA file and write clusters, summary, sequences by cluster and short ones."""
    readers.required(spark, fasta)
    valid, short = clusters.split_short(saved(readers.read_fasta(spark, fasta)))
    found = clusters.anchor_counts(valid, F.col("ord"))
    mapping = saved(clusters.greedy_clusters(found, threshold))
    ranked = saved(clusters.ranked_clusters(valid, mapping))
    members = saved(clusters.memberships(valid, mapping, ranked))
    sinks.write_tsv(members, f"{out}/clusters.tsv")
    sinks.write_tsv(ranked.select(F.concat(F.lit("cluster_"), F.col("cluster_num")).alias("cluster_id"), "representative_anchor", "size"), f"{out}/cluster_summary.tsv")
    sinks.write_fasta(members.select("cluster_id", F.col("peptide_header").alias("header"), "sequence"), f"{out}/fasta", least)
    sinks.write_short(short, f"{out}/short")
    summary = {"n_valid": valid.count(), "n_short": short.count(), "n_anchors": found.count(), **reports.size_buckets(ranked).first().asDict()}
    spark.createDataFrame([(f"{k}: {v}",) for k, v in summary.items()], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary")
    log.info("clusters: %s", summary)
    return summary


def run(spark: SparkSession, observations: str, cluster_tsv: str, out: str | None, cfg: EngineConfig, *, propagate_labels: bool = True, method: str = "gibbs") -> Outcome:
    """Levels 1 to 3 once, or refined for cfg.max_iter iterations; results are written below out unless it is None."""
    readers.required(spark, observations, cluster_tsv)
    raw = readers.read_observations(spark, observations, cfg)
    obs, members = counts.prepared(raw, cfg), readers.read_clusters(spark, cluster_tsv)
    index = saved(counts.allele_index(obs))
    pairs = saved(counts.pair_counts(counts.mapped(obs, counts.cluster_map(members)), index))
    sizes = counts.cluster_sizes(members)
    rates = counts.binder_rates(pairs, index, cfg)
    params = saved(noise.with_tau(noise.noise_params(pairs, index, cfg).join(rates.select("hla_idx", "p_h"), "hla_idx"), cfg))
    called = saved(noise.called(pairs, params, cfg))
    if cfg.max_iter:
        began = datetime.now()
        done = refine.refine(called, index, sizes, cfg, method=method, propagate=propagate_labels, detailed=out is not None)
        if out is not None:
            sinks.write_log(spark, runlog.rendered(done.metrics, cfg, began, index.count()), f"{out}/stage1/{method}_log")
        result = Outcome(done.pairs, done.params, done.tested, done.labels, index, done.metrics, done.similarity, propagate.coverage(pairs, sizes, cfg))
    else:
        tested = saved(similarity.tests(called, cfg))
        labels = saved(propagate.propagated(called, similarity.similarity(tested, cfg), index, sizes, cfg)) if propagate_labels else None
        result = Outcome(called, params, tested, labels, index, [], similarity.similarity(tested, cfg), propagate.coverage(pairs, sizes, cfg))
    if out is not None:
        write(result, rates, out, f"_{method}_final" if cfg.max_iter else "")
    return result


def write(result: Outcome, rates: DataFrame, out: str, suffix: str) -> None:
    """All tables of a run."""
    at = sinks.layout(out)
    pairs, index = result.pairs.withColumn("phi_ch", noise.phi().cast("float")), result.index
    sinks.write_parquet(pairs.drop("gamma64", "previous", "theta"), f"{at['level1']}/level1_results{suffix}.parquet")
    sinks.write_csv(result.params, f"{at['level1']}/noise_params{suffix}.csv", ["hla_idx"])
    sinks.write_csv(diagnostics.allele_purity(pairs, index), f"{at['diagnostics']}/hla_purity.csv", ["hla_idx"])
    sinks.write_csv(diagnostics.cluster_counts(pairs, index, result.params), f"{at['diagnostics']}/hla_cluster_counts.csv", ["hla_idx"])
    sinks.write_csv(diagnostics.phi_histogram(pairs), f"{at['diagnostics']}/phi_histogram.csv", ["bin"])
    sinks.write_csv(index, f"{at['level2']}/hla_index.csv", ["hla_idx"])
    sinks.write_parquet(result.tested, f"{at['level2']}/pairwise_tests.parquet")
    sinks.write_csv(similarity.associations(result.tested, index), f"{at['level2']}/hla_associations.csv", ["hla_idx"])
    names = [r.hla_name for r in index.orderBy("hla_idx").collect()]  # a dictionary
    matrices = {"S": similarity.similarity_long(result.similarity, index)} | {c: similarity.matrix_long(result.tested, index, c) for c in ("OR", "pvalue", "pvalue_adj")}
    for name, matrix in matrices.items():
        matrix = saved(matrix)
        sinks.write_csv(matrix, f"{at['level2']}/{name}_matrix.csv", ["row_name", "col_name"])
        sinks.write_matrix(matrix, names, f"{at['level2']}/{name}_matrix")
    purity = diagnostics.allele_purity(pairs, index)
    sinks.write_csv(diagnostics.spread_histogram(purity, F.round("mean_phi", 6), 60), f"{at['diagnostics']}/mean_phi_histogram.csv", ["bin"])
    associations = similarity.associations(result.tested, index)
    for column in ("n_tested", "n_significant"):
        sinks.write_csv(diagnostics.association_histogram(associations, column), f"{at['diagnostics']}/{column}_histogram.csv", ["bin"])
    for name, kind in (("OR", "or"), ("pvalue", "p"), ("pvalue_adj", "p")):
        sinks.write_csv(diagnostics.heat_cells(matrices[name], kind), f"{at['diagnostics']}/{name}_heat.csv", ["row_name", "col_name"])
    sinks.write_csv(reports.observed_summary(pairs, index), f"{at['diagnostics']}/per_hla_observed_summary.csv", [F.desc("n_clusters"), "hla_idx"])
    labels = result.labels if result.labels is not None else pairs.sparkSession.createDataFrame([], "cluster_id int, hla_idx int, p_tilde float, n_tilde float, lambda_w float")
    sinks.write_csv(reports.run_statistics(result.params, pairs, result.coverage, labels), f"{at['diagnostics']}/run_statistics.csv", ["stage", "value"])
    if result.labels is not None and result.labels.limit(1).count():
        sinks.write_ordered(result.labels, f"{at['level3']}/propagated_labels.parquet", ["hla_idx", "cluster_id"])
        for column in ("p_tilde", "n_tilde", "lambda_w"):
            sinks.write_csv(diagnostics.boxes(result.labels.withColumn(column, F.col(column).cast("double")), "hla_idx", column), f"{at['diagnostics']}/{column}_boxes.csv", ["hla_idx"])
        sinks.write_csv(propagate.propagation_summary(result.labels, index), f"{at['level3']}/propagation_summary.csv", ["hla_idx"])
        sinks.write_csv(reports.propagated_summary(result.labels, index), f"{at['diagnostics']}/per_hla_propagated_summary.csv", ["hla_idx"])
    if result.metrics:
        sinks.write_csv(result.pairs.sparkSession.createDataFrame([(m["iteration"], m["delta_max"], m["delta_mean"]) for m in result.metrics], "iteration int, delta_max double, delta_mean double"), f"{at['level1']}/metrics.csv", ["iteration"])
