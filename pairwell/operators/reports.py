"""Reports on observed and propagated labels, on cluster sizes, and on iteration logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved
from .quantiles import with_medians


def observed_summary(called: DataFrame, index: DataFrame) -> DataFrame:
    """Posterior statistics and label sums of each allele."""
    g = F.col("gamma").cast("double")
    stats = called.groupBy("hla_idx").agg(
        F.avg(g).alias("gamma_mean"), F.stddev_samp(g).alias("gamma_std"), F.min(g).alias("gamma_min"), F.max(g).alias("gamma_max"), F.count("*").alias("gamma_count"),
        F.sum("n_pos").alias("total_pos"), F.sum("n_neg").alias("total_neg"), F.sum("n_total").alias("total_obs"), F.count_distinct("cluster_id").alias("n_clusters"),
    )
    return index.join(with_medians(stats, called, ["hla_idx"], {"gamma": "gamma_median"}), "hla_idx", "left").na.fill(0)


def propagated_summary(labels: DataFrame, index: DataFrame) -> DataFrame:
    """Means, deviations and medians of propagated values by allele."""
    labels = saved(labels)  # read again by each round of the medians
    of = lambda c, n: [F.avg(F.col(c).cast("double")).alias(f"{n}_mean"), F.stddev_samp(F.col(c).cast("double")).alias(f"{n}_std")]
    stats = labels.groupBy("hla_idx").agg(F.count("*").alias("n_propagated"), *of("p_tilde", "ptilde"), *of("n_tilde", "ntilde"), *of("lambda_w", "lambda"), F.count_if(F.col("p_tilde") > 0.5).alias("n_positive"))
    return with_medians(stats, labels, ["hla_idx"], {"p_tilde": "ptilde_median", "n_tilde": "ntilde_median", "lambda_w": "lambda_median"}).join(index, "hla_idx")


def run_summary(called: DataFrame, tested: DataFrame, labels: DataFrame, index: DataFrame) -> DataFrame:
    """One row: observed pairs, propagated pairs, alleles, significant pairs."""
    parts = [called.agg(F.count("*").alias("n_observed")), labels.agg(F.count("*").alias("n_propagated")), index.agg(F.count("*").alias("n_alleles")), tested.agg(F.count_if("significant").alias("n_significant"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def value_summary(rows: DataFrame, column: str, threshold: float) -> DataFrame:
    """n, mean, median, min, max and the number above threshold."""
    rows = saved(rows.select(F.col(column).cast("double").alias("x")))
    x = F.col("x")
    plain = rows.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(x > threshold).alias("n_above"))
    return with_medians(plain, rows, [], {"x": "median"}).select("n", "mean", "median", "min", "max", "n_above")


def run_statistics(params: DataFrame, called: DataFrame, coverage: DataFrame, labels: DataFrame) -> DataFrame:
    """stage, value, and value_summary() of rates, thresholds, posteriors, penalties and propagated labels (params: p_h, tau_h)."""
    parts = [("rates", "p_h", params, 0.5), ("thresholds", "tau_h", params, 0.4999), ("posteriors", "gamma64", called, 0.5), ("coverage", "penalty", coverage, 0.5), ("propagation", "p_tilde", labels, 0.5), ("propagation", "lambda_w", labels, 0.5)]
    out = None
    for stage, value, rows, threshold in parts:
        part = value_summary(rows, value, threshold).select(F.lit(stage).alias("stage"), F.lit(value).alias("value"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def size_buckets(sizes: DataFrame) -> DataFrame:
    """Numbers of clusters with 1, 2-10, 11-100, 101-1000 and more members (column size)."""
    between = lambda lo, hi: F.count_if(F.col("size").between(lo, hi))
    return sizes.agg(between(1, 1).alias("singletons"), between(2, 10).alias("to_10"), between(11, 100).alias("to_100"), between(101, 1000).alias("to_1000"), F.count_if(F.col("size") > 1000).alias("above"), F.max("size").alias("largest"))


def cluster_report(edges: DataFrame) -> DataFrame:
    """One row on clusters given as rep, member."""
    sizes = saved(edges.groupBy("rep").agg(F.count("*").alias("size")))
    n, one = F.count("*"), F.count_if(F.col("size") == 1)
    plain = sizes.agg(F.sum("size").alias("n_members"), n.alias("n_clusters"), one.alias("n_singletons"), F.try_divide(100.0 * one, n).alias("pct_singletons"), F.max("size").alias("max_size"), F.avg("size").alias("mean_size"))
    return with_medians(plain, sizes, [], {"size": "median_size"})


def extreme_clusters(edges: DataFrame, sequences: DataFrame, n: int = 5) -> DataFrame:
    """The n largest and n smallest clusters (end, rep, size, sequence), ties by rep; sequences: ord, header, sequence."""
    sizes = saved(edges.groupBy("rep").agg(F.count("*").alias("size")))  # read from both ends
    ends = [sizes.orderBy(F.desc("size"), "rep").limit(n).withColumn("end", F.lit("top")), sizes.orderBy("size", F.desc("rep")).limit(n).withColumn("end", F.lit("bottom"))]
    both = saved(ends[0].unionByName(ends[1]))
    wanted = F.broadcast(both.select(F.col("rep").alias("header")).distinct())  # 2 * n rows: sequences needn't be grouped but for these
    last = sequences.join(wanted, "header", "left_semi").groupBy("header").agg(F.max_by("sequence", "ord").alias("sequence"))
    return both.join(last, both["rep"] == last["header"], "left").select("end", "rep", "size", F.coalesce("sequence", F.lit("[Sequence Not Found]")).alias("sequence"))


# Where an iteration log states a column. A line's shape is its text with every number as #; a column is
# the number so many places behind a part of a shape. (column, part, place, type, description)
LOG_FIELDS = [
    ("theta_binders", "Sampled theta: ", 0, "long", "pairs whose state was binding"),
    ("theta_pct", "Sampled theta: ", 2, "double", "the same in percent of all pairs"),
    ("alpha_mean", "alpha: mean=", 0, "double", "missed bindings, mean over alleles"),
    ("beta_mean", "beta: mean=", 0, "double", "spurious bindings, mean over alleles"),
    ("ph_mean", "p_h: mean=", 0, "double", "prior of binding, mean over alleles"),
    ("ph_median", "p_h: mean=", 1, "double", "prior of binding, median over alleles"),
    ("gamma_mean", "gamma: mean=", 0, "double", "posterior, mean over pairs"),
    ("gamma_median", "gamma: mean=", 1, "double", "posterior, median over pairs"),
    ("gamma_gt_half", ">#: ", 0, "long", "pairs with a posterior above one half"),
    ("tau_mean", "tau_h: mean=", 0, "double", "threshold of calls, mean over alleles"),
    ("tau_median", "tau_h: mean=", 1, "double", "threshold of calls, median over alleles"),
    ("tau_cap_count", "tau_max cap applied to ", 0, "long", "alleles whose threshold was capped"),
    ("positive_calls", "Positive calls: ", 0, "long", "pairs called binding"),
    ("positive_pct", "Positive calls: ", 2, "double", "the same in percent of all pairs"),
    ("delta_gamma_max", "max|delta gamma| = ", 0, "double", "largest move of a posterior"),
    ("delta_gamma_mean", "mean|delta| = ", 0, "double", "mean move of the posteriors"),
    ("l2_significant_pairs", "Significant pairs: ", 0, "long", "pairs of alleles found similar or opposed"),
    ("l2_nonzero_entries", "Non-zero entries: ", 0, "long", "cells of the similarity matrix that aren't 0"),
    ("l3_propagated", "Propagated pairs: ", 0, "long", "unobserved pairs that got a label"),
    ("l3_positive", "Positive-leaning (p_tilde > #): ", 0, "long", "those of them that lean to binding"),
    ("l3_lambda_mean", "Mean lambda: ", 0, "double", "their confidence, mean"),
    ("iteration_time", "Iteration # done (", 0, "double", "seconds it took"),
]
NUMBER = r"\d[\d,]*(?:\.\d+)?"


def log_table(logs: DataFrame, text: str = "value") -> DataFrame:
    """iteration and LOG_FIELDS of each iteration's block in whole logs; null where a block lacks a line."""
    head = r"--- Gibbs Iteration (\d+)/\d+ ---"
    numbers = F.regexp_extract_all(text, F.lit(head), F.lit(1))
    blocks = F.slice(F.split(text, head), 2, F.greatest(F.size(F.split(text, head)) - 1, F.lit(0)))
    rows = logs.select(F.explode(F.arrays_zip(numbers.alias("i"), blocks.alias("b"))).alias("x"))
    shaped = lambda line: F.struct(F.regexp_replace(line, NUMBER, "#").alias("shape"), F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0)).alias("numbers"))
    rows = rows.select(F.col("x.i").cast("int").alias("iteration"), F.transform(F.split("x.b", "\n"), shaped).alias("lines"))

    def field(part: str, place: int, kind: str) -> Column:
        line = F.get(F.filter("lines", lambda x: x["shape"].contains(part)), F.lit(0))
        ahead = F.substring_index(line["shape"], part, 1)
        before = F.length(ahead) - F.length(F.replace(ahead, F.lit("#"), F.lit(""))) + part.count("#")
        return F.replace(F.get(line["numbers"], before + place), F.lit(","), F.lit("")).try_cast(kind)

    return rows.select("iteration", *[field(part, place, kind).alias(name) for name, part, place, kind, _ in LOG_FIELDS])


def column_descriptions(columns: list[str]) -> dict[str, str]:
    """What the columns of log_table() mean."""
    known = {"iteration": "number of the iteration"} | {name: said for name, *_, said in LOG_FIELDS}
    return {c: known.get(c, c) for c in columns}
