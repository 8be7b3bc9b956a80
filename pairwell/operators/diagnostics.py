"""Summaries of alleles, and the data of their plots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from .noise import phi
from .quantiles import quantiles, with_medians


def allele_purity(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """hla_idx, hla_name, mean, std (0 of one), median, min, max of phi, n_clusters; zeros without pairs."""
    rows = pairs.select("hla_idx", phi().alias("phi"))
    x = F.col("phi")
    stats = rows.groupBy("hla_idx").agg(F.avg(x).alias("mean_phi"), F.stddev_samp(x).alias("std_phi"), F.min(x).alias("min_phi"), F.max(x).alias("max_phi"), F.count("*").alias("n_clusters"))
    return index.join(with_medians(stats, rows, ["hla_idx"], {"phi": "median_phi"}), "hla_idx", "left").na.fill(0)


def cluster_counts(called: DataFrame, index: DataFrame, rates: DataFrame) -> DataFrame:
    """Binding, other and all clusters of each allele, and the binding share."""
    stats = called.groupBy("hla_idx").agg(F.sum(F.col("b_call").cast("long")).alias("n_binder_clusters"), F.count("*").alias("n_total_clusters"))
    out = index.join(rates.select("hla_idx", "p_h"), "hla_idx", "left").join(stats, "hla_idx", "left").na.fill(0)
    share = F.coalesce(F.try_divide("n_binder_clusters", "n_total_clusters"), F.lit(0.0))
    return out.withColumns({"n_nonbinder_clusters": F.col("n_total_clusters") - F.col("n_binder_clusters"), "binder_fraction": share})


def top_alleles(counts: DataFrame, n: int = 30) -> DataFrame:
    """The n alleles with most clusters."""
    return counts.orderBy(F.desc("n_total_clusters"), "hla_idx").limit(n)


def histogram(rows: DataFrame, value: Column, bins: int, low: float, high: float) -> DataFrame:
    """bin, bin_low, n of value in equal bins of [low, high]; values beyond go to the edge bins, nulls to none."""
    width = (high - low) / bins
    x = F.least(F.greatest(F.floor((value - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.where(value.isNotNull()).groupBy(x.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(low) + F.col("bin") * width).alias("bin_low"), "n")


def spread_histogram(rows: DataFrame, value: Column, bins: int) -> DataFrame:
    """bin, bin_low, n between the least and greatest value."""
    bounds = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    binned = rows.select(value.alias("x")).where("x is not null").crossJoin(bounds)
    at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return binned.groupBy(at.alias("bin"), (F.col("lo") + at * width).alias("bin_low")).agg(F.count("*").alias("n"))


def phi_histogram(pairs: DataFrame) -> DataFrame:
    """phi clipped to [-15, 15] in 120 bins."""
    return histogram(pairs, phi(), 120, -15.0, 15.0)


def association_histogram(associations: DataFrame, column: str = "n_significant", bins: int = 40) -> DataFrame:
    """log10(n + 1) of positive counts."""
    return spread_histogram(associations.where(F.col(column) > 0), F.log10(F.col(column) + 1), bins)


def sampled(rows: DataFrame, group: str, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group (the sampling operator): those with the least MD5 of seed and keys."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary"))
    order = F.row_number().over(Window.partitionBy(group).orderBy(digest, *keys))
    return rows.withColumn("_k", order).where(F.col("_k") <= n).drop("_k")


def normal(seed: int, *keys: str) -> Column:
    """A standard normal draw for keys, from two uniform ones of their hash: the same for any partitioning, and in any SQL."""
    radius = F.sqrt(-2 * F.ln(1 - uniform(seed, 1, *keys)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed, 2, *keys))


def jittered(rows: DataFrame, group: str, keys: list[str], value: str, n: int = 300, spread: float = 0.08, seed: int = 0) -> DataFrame:
    """group, keys, x and y of at most n points of each group (sampled()): y is value, x the group's number moved by a normal draw."""
    x = F.col(group) + F.lit(spread) * normal(seed, *keys)
    return sampled(rows, group, keys, n, seed).select(*dict.fromkeys([group, *keys]), x.alias("x"), F.col(value).alias("y"))


def boxes(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, q1, median, q3, low and high whiskers (1.5 spreads)."""
    quartiles = quantiles(rows, [group], [value], [0.25, 0.5, 0.75]).select(group, F.col(value).alias("q"))
    quartiles = quartiles.join(rows.groupBy(group).agg(F.count(value).alias("n")), group)
    spread = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = rows.join(quartiles, group).where((F.col(value) >= F.col("q")[0] - spread) & (F.col(value) <= F.col("q")[2] + spread))
    return inside.groupBy(group).agg(F.first("n").alias("n"), F.first("q")[0].alias("q1"), F.first("q")[1].alias("median"), F.first("q")[2].alias("q3"), F.min(value).alias("low"), F.max(value).alias("high"))


def sign_bars(summary: DataFrame) -> DataFrame:
    """hla_idx, hla_name, up = ln(pos + 1), down = -ln(neg + 1)."""
    return summary.select("hla_idx", "hla_name", F.ln(F.col("total_pos") + 1).alias("up"), (-F.ln(F.col("total_neg") + 1)).alias("down"))


def heat_cells(matrix: DataFrame, kind: str) -> DataFrame:
    """row_name, col_name, shade: log10 of odds ratios, or -log10 of p-values; the diagonal counts as 1."""
    x = F.coalesce("value", F.lit(1.0))
    shade = F.log10(F.greatest(x, F.lit(1e-10))) if kind == "or" else -F.log10(F.least(F.greatest(x, F.lit(1e-300)), F.lit(1.0)))
    return matrix.select("row_name", "col_name", shade.alias("shade"))
