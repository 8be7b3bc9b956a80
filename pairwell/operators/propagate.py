"""Propagation of posteriors to unobserved pairs of rare alleles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..sources.tables import saved

#: Up to so many similar pairs of alleles are broadcast.
MOST_WEIGHTS = 250_000


def weights(s: DataFrame) -> DataFrame:
    """h_src, h_tgt, w of positive similarities."""
    return s.where("s > 0").select(F.col("h1").alias("h_src"), F.col("h2").alias("h_tgt"), F.col("s").alias("w"))


def targets(pairs: DataFrame, index: DataFrame, cfg: EngineConfig) -> DataFrame:
    """hla_idx, n_pairs of the alleles that get labels: those with few pairs, or all."""
    counts = index.select("hla_idx").join(pairs.groupBy("hla_idx").agg(F.count("*").alias("n_pairs")), "hla_idx", "left").na.fill(0, ["n_pairs"])
    return counts.where(F.col("n_pairs") < cfg.rare_max_pairs) if cfg.only_rare else counts


def coverage(pairs: DataFrame, sizes: DataFrame, cfg: EngineConfig) -> DataFrame:
    """cluster_id, n_labelled, n_members, penalty; clusters without a size count one member."""
    labelled = pairs.groupBy("cluster_id").agg(F.sum("n_total").alias("n_labelled"))
    n = F.greatest(F.coalesce("n_members", F.lit(1)), F.lit(1))
    share = F.least(F.col("n_labelled") / n, F.lit(1.0))
    return labelled.join(sizes, "cluster_id", "left").select("cluster_id", "n_labelled", n.alias("n_members"), F.pow(share, F.lit(cfg.coverage_tau)).alias("penalty"))


def propagated(pairs: DataFrame, s: DataFrame, index: DataFrame, sizes: DataFrame, cfg: EngineConfig) -> DataFrame:
    """cluster_id, hla_idx, p_tilde, n_tilde, lambda_w (floats) of unobserved pairs with a similar observed one.

    All targets in one join: a pair meets the targets of its allele, at most H; sums of a cluster's
    sources are made before the anti-join with what is observed. The weights are broadcast while they
    are few (MOST_WEIGHTS), else joined by allele. Without any, neither pairs nor sizes are read.
    """
    w = weights(s).join(targets(pairs, index, cfg).select(F.col("hla_idx").alias("h_tgt")), "h_tgt", "left_semi")
    source = pairs.select("cluster_id", F.col("hla_idx").alias("h_src"), F.col("gamma").cast("double").alias("g"), "n_total").join(coverage(pairs, sizes, cfg).select("cluster_id", "penalty"), "cluster_id")
    w = saved(w)
    n_weights = w.count()
    w = w if n_weights else w.limit(0)  # which Spark knows to be empty, and all joins with it
    sums = source.join(F.broadcast(w) if n_weights <= MOST_WEIGHTS else w, "h_src").groupBy("cluster_id", F.col("h_tgt").alias("hla_idx")).agg(F.sum(F.col("w") * F.col("g")).alias("wg"), F.sum("w").alias("ws"), F.sum(F.col("w") * F.col("n_total") * F.col("penalty")).alias("wn"))
    new = sums.join(pairs.select("cluster_id", "hla_idx"), ["cluster_id", "hla_idx"], "left_anti")
    return new.select("cluster_id", "hla_idx", (F.col("wg") / F.col("ws")).cast("float").alias("p_tilde"), F.col("wn").cast("float").alias("n_tilde"), (F.col("wn") / (F.col("wn") + cfg.kappa)).cast("float").alias("lambda_w"))


def propagation_summary(labels: DataFrame, index: DataFrame) -> DataFrame:
    """hla_idx, hla_name, n_propagated, mean_p_tilde, mean_lambda, n_positive."""
    stats = labels.groupBy("hla_idx").agg(F.count("*").alias("n_propagated"), F.avg("p_tilde").alias("mean_p_tilde"), F.avg("lambda_w").alias("mean_lambda"), F.count_if(F.col("p_tilde") > 0.5).alias("n_positive"))
    return stats.join(index, "hla_idx")


def feedback(labels: DataFrame, params: DataFrame, cfg: EngineConfig) -> DataFrame:
    """params (hla_idx, p_h, ...) with p_h moved to the propagated rate, by its share of the weight."""
    sums = labels.groupBy("hla_idx").agg(F.sum(F.col("lambda_w").cast("double") * F.col("p_tilde").cast("double")).alias("fp"), F.sum(F.col("lambda_w").cast("double")).alias("fw"))
    share = F.col("fw") / (F.col("fw") + cfg.feedback_weight)
    moved = (1 - share) * F.col("p_h") + share * F.col("fp") / F.col("fw")
    joined = params.join(sums, "hla_idx", "left")
    return joined.withColumn("p_h", F.when(F.col("fw") > 0, moved).otherwise(F.col("p_h"))).drop("fp", "fw")
