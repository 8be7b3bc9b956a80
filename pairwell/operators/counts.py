"""Observations to counts of (cluster, allele) pairs, and shrunken rates of alleles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig

#: Alleles have numbers of 16 bits.
MOST_ALLELES = 32_767


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def prepared(raw: DataFrame, cfg: EngineConfig) -> DataFrame:
    """peptide, allele, label: renamed, alleles filtered by prefix, null labels 0, null alleles dropped.

    Labels other than 0 and 1 are an error when the rows are read.
    """
    peptide = F.upper(F.col(cfg.peptide_col)) if cfg.normalize_case else F.col(cfg.peptide_col)
    label = F.coalesce(F.col(cfg.label_col).cast("int"), F.lit(0))
    rows = raw.select(peptide.alias("peptide"), F.col(cfg.allele_col).alias("allele"), F.when(label.isin(0, 1), label).otherwise(F.raise_error(F.lit("labels are 0, 1 or null"))).cast("tinyint").alias("label"))
    if cfg.allele_prefix:
        rows = rows.where(F.col("allele").startswith(cfg.allele_prefix))
    return rows.where(F.col("allele").isNotNull())


def dropped_alleles(raw: DataFrame, cfg: EngineConfig) -> DataFrame:
    """n_rows, n_null_allele: what prepared() drops for want of an allele."""
    return raw.agg(F.count("*").alias("n_rows"), F.count_if(F.col(cfg.allele_col).isNull()).alias("n_null_allele"))


def cluster_map(members: DataFrame) -> DataFrame:
    """sequence, cluster_id (number of `cluster_<n>`), one row a sequence; two clusters for one are an error."""
    number = F.split("cluster_id", "_", 2)[1].cast("int")
    ids = members.select("sequence", number.alias("c")).groupBy("sequence").agg(F.min("c").alias("cluster_id"), F.max("c").alias("other"))
    same = F.when(F.col("cluster_id") == F.col("other"), F.col("cluster_id")).otherwise(F.raise_error(F.concat(F.lit("two clusters for "), F.col("sequence"))).cast("int"))
    return ids.select("sequence", same.alias("cluster_id"))


def mapped(observations: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_id, allele, label of observations whose peptide is in a cluster."""
    return observations.join(clusters, observations["peptide"] == clusters["sequence"]).select("cluster_id", "allele", "label")


def unmapped(observations: DataFrame, clusters: DataFrame) -> DataFrame:
    """n_obs, n_unmapped, pct_unmapped."""
    found = observations.join(clusters.withColumn("hit", F.lit(1)), observations["peptide"] == clusters["sequence"], "left")
    n, gone = F.count("*"), F.count_if(F.col("hit").isNull())
    return found.agg(n.alias("n_obs"), gone.alias("n_unmapped"), F.coalesce(F.try_divide(100.0 * gone, n), F.lit(0.0)).alias("pct_unmapped"))


def cluster_sizes(members: DataFrame) -> DataFrame:
    """cluster_id, n_members: rows of each cluster, repeated sequences included."""
    return members.groupBy(F.split("cluster_id", "_", 2)[1].cast("int").alias("cluster_id")).agg(F.count("*").alias("n_members"))


def allele_index(observations: DataFrame) -> DataFrame:
    """hla_idx, hla_name: dense numbers of the sorted distinct names.

    A small dictionary, so one window; more than MOST_ALLELES are an error. That bounds this table and
    all with a row an allele, which is why they are broadcast.
    """
    names = observations.select(F.col("allele").alias("hla_name")).distinct()
    place = F.row_number().over(Window.orderBy("hla_name")) - 1
    few = F.when(place < MOST_ALLELES, place).otherwise(F.raise_error(F.lit(f"more than {MOST_ALLELES} alleles")).cast("int"))
    return names.select(few.alias("hla_idx"), "hla_name")


def pair_sums(rows: DataFrame) -> DataFrame:
    """cluster_id, allele, n_pos, n_total of each observed pair."""
    return rows.groupBy("cluster_id", "allele").agg(F.sum(F.col("label").cast("long")).alias("n_pos"), F.count("*").alias("n_total"))


def indexed(sums: DataFrame, index: DataFrame) -> DataFrame:
    """pair_sums() with the alleles' numbers: cluster_id, hla_idx, n_pos, n_neg, n_total."""
    named = sums.join(F.broadcast(index), sums["allele"] == index["hla_name"])
    return named.select("cluster_id", "hla_idx", "n_pos", (F.col("n_total") - F.col("n_pos")).alias("n_neg"), "n_total")


def pair_counts(rows: DataFrame, index: DataFrame) -> DataFrame:
    """cluster_id, hla_idx, n_pos, n_neg, n_total of each observed pair."""
    return indexed(pair_sums(rows), index)


def label_distribution(observations: DataFrame) -> DataFrame:
    """n_pos, n_neg, positive_rate."""
    n, pos = F.count("*"), F.count_if(F.col("label") == 1)
    return observations.agg(pos.alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"), F.coalesce(F.try_divide(pos, n), F.lit(0.0)).alias("positive_rate"))


def reconciliation(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sums of the observations and of their pairs, which must agree, and the number of clusters and pairs."""
    left = rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("rows_pos"))
    right = pairs.agg(F.coalesce(F.sum("n_total"), F.lit(0)).alias("pairs_total"), F.coalesce(F.sum("n_pos"), F.lit(0)).alias("pairs_pos"), F.count_distinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_pairs"))
    return left.crossJoin(right).withColumn("agrees", (F.col("n_rows") == F.col("pairs_total")) & (F.col("rows_pos") == F.col("pairs_pos")))  # one row each


def shrunken(totals: DataFrame, cfg: EngineConfig) -> DataFrame:
    """totals (hla_idx, pos, tot) with p_raw and p_h, shrunken to the rate of all by cfg.shrinkage_k."""
    everything = totals.agg(F.try_divide(F.sum("pos"), F.sum("tot")).alias("p_global"))  # one row
    joined = totals.crossJoin(everything)
    p = (F.col("pos") + cfg.shrinkage_k * F.col("p_global")) / (F.col("tot") + F.lit(cfg.shrinkage_k))
    return joined.select("hla_idx", "pos", "tot", F.coalesce(F.try_divide("pos", "tot"), F.lit(0.0)).alias("p_raw"), clip(p, cfg.rate_floor, cfg.rate_ceil).alias("p_h"))


def binder_rates(pairs: DataFrame, index: DataFrame, cfg: EngineConfig) -> DataFrame:
    """hla_idx, pos, tot, p_raw, p_h of every allele, also those without pairs."""
    sums = pairs.groupBy("hla_idx").agg(F.sum("n_pos").alias("pos"), F.sum("n_total").alias("tot"))
    return shrunken(index.select("hla_idx").join(sums, "hla_idx", "left").na.fill(0, ["pos", "tot"]), cfg)
