"""The two-state noise model: error rates of alleles, posteriors of pairs, calls and log-ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from .counts import clip


def _rates(pairs: DataFrame, index: DataFrame, binder: Column, other: Column, cfg: EngineConfig) -> DataFrame:
    """hla_idx, alpha, beta: Beta means of the errors among `binder` and `other` pairs."""
    sums = pairs.groupBy("hla_idx").agg(*[F.sum(F.when(mask, F.col(c)).otherwise(0)).alias(name) for mask, c, name in ((binder, "n_neg", "fn"), (binder, "n_total", "nb"), (other, "n_pos", "fp"), (other, "n_total", "no"))])
    all_of_them = index.select("hla_idx").join(sums, "hla_idx", "left").na.fill(0)
    mean = lambda prior, wrong, n: (F.lit(prior[0]) + F.col(wrong)) / (F.lit(sum(prior)) + F.col(n))
    return all_of_them.select("hla_idx", clip(mean(cfg.alpha_prior, "fn", "nb"), *cfg.alpha_range).alias("alpha"), clip(mean(cfg.beta_prior, "fp", "no"), *cfg.beta_range).alias("beta"))


def noise_params(pairs: DataFrame, index: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Error rates from nearly unanimous pairs."""
    enough = F.col("n_total") >= cfg.noise_min_total
    share = lambda c: F.col(c) / F.col("n_total") > cfg.noise_purity
    return _rates(pairs, index, enough & share("n_pos"), enough & share("n_neg"), cfg)


def noise_from_theta(pairs: DataFrame, index: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Error rates from pairs with a state theta (0 or 1)."""
    return _rates(pairs, index, F.col("theta") == 1, F.col("theta") == 0, cfg)


def with_tau(params: DataFrame, cfg: EngineConfig) -> DataFrame:
    """params with tau_h, the threshold of calls."""
    return params.withColumn("tau_h", F.least(F.lit(cfg.tau_multiplier) * F.col("p_h"), F.lit(cfg.tau_max)))


def logs(alpha: Column, beta: Column, p: Column) -> tuple[Column, ...]:
    """What posterior_of() takes from an allele's rates."""
    return F.ln(p), F.ln(1 - alpha), F.ln(alpha), F.ln(1 - p), F.ln(beta), F.ln(1 - beta)


def posterior_of(n_pos: Column, n_neg: Column, p: Column, hit: Column, miss: Column, q: Column, false: Column, right: Column) -> Column:
    """The probability that a pair binds, by logs()."""
    odds = p + n_pos * hit + n_neg * miss - q - n_pos * false - n_neg * right
    return clip(1 / (1 + F.exp(-clip(odds, -500.0, 500.0))), 1e-10, 1 - 1e-10)


def posterior(n_pos: Column, n_neg: Column, alpha: Column, beta: Column, p: Column) -> Column:
    """The probability that a pair binds."""
    return posterior_of(n_pos, n_neg, *logs(alpha, beta, p))


def called(pairs: DataFrame, params: DataFrame, cfg: EngineConfig) -> DataFrame:
    """pairs with gamma64, gamma (stored as float) and b_call; params: hla_idx, alpha, beta, p_h, a row an allele.

    Logarithms are taken of the alleles' rates, not again for each pair.
    """
    of_allele = [x.alias(f"_log{i}") for i, x in enumerate(logs(F.col("alpha"), F.col("beta"), F.col("p_h")))]
    joined = pairs.join(F.broadcast(with_tau(params, cfg).select("hla_idx", "tau_h", *of_allele)), "hla_idx")
    joined = joined.withColumn("gamma64", posterior_of(F.col("n_pos"), F.col("n_neg"), *[F.col(f"_log{i}") for i in range(len(of_allele))]))
    return joined.select(*pairs.columns, "gamma64", F.col("gamma64").cast("float").alias("gamma"), (F.col("gamma64") > F.col("tau_h")).cast("tinyint").alias("b_call"))


def phi() -> Column:
    """The log-ratio of positive to negative labels."""
    return F.ln((F.col("n_pos") + F.lit(1e-6)) / (F.col("n_neg") + F.lit(1e-6)))
