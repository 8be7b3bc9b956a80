"""The log of a refinement as data: what each iteration states, and the text that reports.log_table() reads back."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..sources.tables import saved
from .quantiles import quantiles


def observed(df: DataFrame, numbers: dict[str, Column]) -> tuple[DataFrame, dict]:
    """df, saved, and aggregates of it taken while it was written; of an empty table, whose observation Spark may leave out, afterwards."""
    seen, named = Observation(), [c.alias(n) for n, c in numbers.items()]
    out = saved(df.observe(seen, *named))
    try:
        return out, seen.get
    except (PySparkException, Exception):  # noqa: BLE001 (the library fails in several ways on an observation without a row)
        return out, out.agg(*named).first().asDict()


def of_pairs(cfg: EngineConfig) -> dict[str, Column]:
    """What an iteration's pairs tell, for observed()."""
    move = F.abs(F.col("gamma64") - F.col("previous"))
    return {
        "n_pairs": F.count(F.lit(1)), "theta_binders": F.sum(F.col("theta").cast("long")), "gamma_sum": F.sum("gamma64"), "gamma_gt_half": F.count_if(F.col("gamma64") > 0.5),
        "positive_calls": F.sum(F.col("b_call").cast("long")), "delta_gamma_max": F.max(move), "delta_gamma_sum": F.sum(move),
    }


def stated(pairs: DataFrame, params: DataFrame, seen: dict, cfg: EngineConfig, *, s: DataFrame | None, tested: DataFrame | None, labels: DataFrame | None, seconds: float) -> dict:
    """The values of reports.LOG_FIELDS of an iteration; None for what it didn't do.

    pairs are read for the median alone, params are a row an allele.
    """
    n = seen["n_pairs"] or 0
    share = lambda x: 100.0 * x / n if n and x is not None else None
    mean = lambda x: x / n if n and x is not None else None
    tau = F.lit(cfg.tau_multiplier) * F.col("p_h")
    p = params.agg(F.avg("alpha").alias("alpha_mean"), F.avg("beta").alias("beta_mean"), F.avg("p_h").alias("ph_mean"), F.avg("tau_h").alias("tau_mean"), F.count_if(tau > cfg.tau_max).alias("tau_cap_count")).first().asDict()
    medians = quantiles(params, [], ["p_h", "tau_h"], [0.5]).first()
    middle = quantiles(pairs, [], ["gamma64"], [0.5]).first()
    first = lambda x: x[0] if x else None
    out = {
        "theta_binders": seen["theta_binders"], "theta_pct": share(seen["theta_binders"]), **p, "ph_median": first(medians and medians.p_h), "tau_median": first(medians and medians.tau_h),
        "gamma_mean": mean(seen["gamma_sum"]), "gamma_median": first(middle and middle.gamma64), "gamma_gt_half": seen["gamma_gt_half"], "positive_calls": seen["positive_calls"] or 0, "positive_pct": share(seen["positive_calls"]),
        "delta_gamma_max": seen["delta_gamma_max"], "delta_gamma_mean": mean(seen["delta_gamma_sum"]), "iteration_time": seconds, "n_pairs": n,
    }
    if tested is not None:
        out |= {"l2_significant_pairs": tested.where("significant").count(), "l2_tested": tested.count(), "l2_nonzero_entries": s.where("s <> 0").count()}
    if labels is not None:
        got = labels.agg(F.count("*").alias("n"), F.count_if(F.col("p_tilde") > 0.5).alias("up"), F.avg(F.col("lambda_w").cast("double")).alias("m")).first()
        out |= {"l3_propagated": got.n, "l3_positive": got.up, "l3_lambda_mean": got.m}
    return out


# The lines of an iteration, in order, each with the numbers that it needs.
LINES = [
    ("  Sampled theta: {theta_binders:,}/{n_pairs:,} binders ({theta_pct:.2f}%)", ("theta_binders", "theta_pct")),
    ("  alpha: mean={alpha_mean:.4f}, beta: mean={beta_mean:.4f}", ("alpha_mean", "beta_mean")),
    ("  p_h: mean={ph_mean:.4f}, median={ph_median:.4f}", ("ph_mean", "ph_median")),
    ("  gamma: mean={gamma_mean:.4f}, median={gamma_median:.4f}", ("gamma_mean", "gamma_median")),
    ("  >0.5: {gamma_gt_half:,}/{n_pairs:,}", ("gamma_gt_half",)),
    ("  tau_h: mean={tau_mean:.4f}, median={tau_median:.4f}", ("tau_mean", "tau_median")),
    ("  tau_max cap applied to {tau_cap_count}/{n_alleles} alleles", ("tau_cap_count", "n_alleles")),
    ("  Positive calls: {positive_calls:,}/{n_pairs:,} ({positive_pct:.2f}%)", ("positive_calls", "positive_pct")),
    ("  max|delta gamma| = {delta_gamma_max:.6f}, mean|delta| = {delta_gamma_mean:.6f}", ("delta_gamma_max", "delta_gamma_mean")),
    ("  Significant pairs: {l2_significant_pairs:,} / {l2_tested:,} (FDR < {fdr})", ("l2_significant_pairs", "l2_tested")),
    ("  Non-zero entries: {l2_nonzero_entries:,}", ("l2_nonzero_entries",)),
    ("  Propagated pairs: {l3_propagated:,}", ("l3_propagated",)),
    ("  Positive-leaning (p_tilde > 0.5): {l3_positive:,}", ("l3_positive",)),
    ("  Mean lambda: {l3_lambda_mean:.4f}", ("l3_lambda_mean",)),
]


def rendered(metrics: list[dict], cfg: EngineConfig, started: datetime, n_alleles: int) -> str:
    """The text of a run's log: the day and time it began, and a block an iteration. Lines lack where their numbers do."""
    out = [f"Run of {started:%Y-%m-%d %H:%M:%S}: {n_alleles} alleles, seed {cfg.seed}"]
    for m in metrics:
        known = {k: v for k, v in m.items() if v is not None} | {"n_alleles": n_alleles, "fdr": cfg.fdr}
        out.append(f"--- Gibbs Iteration {m['iteration']}/{cfg.max_iter} ---")
        out += [line.format(**known) for line, needs in LINES if all(x in known for x in needs)]
        out.append(f"  Iteration {m['iteration']} done ({known['iteration_time']:.1f}s)")
    return "\n".join(out) + "\n"
