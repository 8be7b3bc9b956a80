"""Iterative refinement of posteriors to a fixed point: sampled or hard states, or soft ones."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.draws import uniform
from ..sources.tables import dropped, saved
from . import runlog
from .counts import clip, shrunken
from .noise import called, noise_from_theta, noise_params, with_tau
from .propagate import feedback, propagated
from .similarity import similarity, tests


@dataclass
class Refined:
    """What a refinement ends with; metrics has a row for each iteration."""

    pairs: DataFrame
    params: DataFrame
    tested: DataFrame
    similarity: DataFrame
    labels: DataFrame | None
    metrics: list[dict]


def states(pairs: DataFrame, cfg: EngineConfig, iteration: int) -> DataFrame:
    """pairs with theta: drawn with probability gamma, or gamma > 0.5."""
    draw = uniform(cfg.seed, iteration, "cluster_id", "hla_idx") if cfg.sample_theta else F.lit(0.5)
    return pairs.withColumn("theta", (draw < F.col("gamma").cast("double")).cast("tinyint"))


def _rates(pairs: DataFrame, index: DataFrame, weight: Column, cfg: EngineConfig) -> DataFrame:
    """hla_idx, p_h: shrunken share of pairs by weight."""
    sums = pairs.groupBy("hla_idx").agg(F.sum(weight).alias("pos"), F.count("*").alias("tot"))
    return shrunken(index.select("hla_idx").join(sums, "hla_idx", "left").na.fill(0), cfg).select("hla_idx", "p_h")


def step(pairs: DataFrame, index: DataFrame, labels: DataFrame | None, cfg: EngineConfig, iteration: int, method: str = "gibbs") -> tuple[DataFrame, DataFrame]:
    """One iteration: pairs with new gamma64, gamma and b_call, previous and theta (null without states); and their parameters."""
    counts = [c for c in pairs.columns if c not in ("gamma64", "gamma", "b_call", "previous", "theta")]
    kept = pairs.withColumn("theta", F.lit(None).cast("tinyint"))
    if method == "gibbs":
        kept = theta = states(pairs, cfg, iteration)
        errors, rates = noise_from_theta(theta, index, cfg), _rates(theta, index, F.col("theta").cast("double"), cfg)
        if labels is not None:
            rates = feedback(labels, rates, cfg)
        rates = rates.withColumn("p_h", clip(F.col("p_h"), cfg.rate_floor, cfg.rate_ceil))
    elif method == "em":
        errors, rates = noise_params(pairs, index, cfg), _rates(pairs, index, F.col("gamma").cast("double"), cfg)
    else:
        raise ValueError(f"unknown method {method}")
    params = errors.join(rates, "hla_idx")
    before = F.col("gamma").cast("double") if iteration == 1 else F.col("gamma64")
    return called(kept.select(*counts, before.alias("previous"), "theta"), params, cfg), params


def change(pairs: DataFrame) -> DataFrame:
    """delta_max, delta_mean of gamma64 from previous."""
    delta = F.abs(F.col("gamma64") - F.col("previous"))
    return pairs.agg(F.max(delta).alias("delta_max"), F.avg(delta).alias("delta_mean"))


def refine(pairs: DataFrame, index: DataFrame, sizes: DataFrame, cfg: EngineConfig, *, method: str = "gibbs", propagate: bool = True, detailed: bool = False) -> Refined:
    """Iterate from called pairs until gamma moves by less than cfg.tol, or cfg.max_iter times.

    Similarity and labels are renewed every cfg.recompute_every iterations and at the end. Each
    iteration's pairs are written to the shared folder, and dropped after the next; what metrics says of them is
    observed while they are written. With detailed, metrics has all that the log states (runlog.stated).
    """
    if cfg.max_iter < 1:
        raise ValueError("refinement needs max_iter of at least 1")
    labels, tested, s, metrics = None, None, None, []
    params = None
    for iteration in range(1, cfg.max_iter + 1):
        began, before = time.time(), pairs
        new, params = step(pairs, index, labels, cfg, iteration, method)
        params = saved(with_tau(params, cfg))
        pairs, seen = runlog.observed(new, runlog.of_pairs(cfg))
        if iteration > 1:
            dropped(before)
        moved = seen["delta_gamma_max"]
        metrics.append({"iteration": iteration, "delta_max": moved, "delta_mean": None if moved is None else seen["delta_gamma_sum"] / seen["n_pairs"]})
        settled = moved is None or moved < cfg.tol
        renewed = settled or iteration == cfg.max_iter or iteration % cfg.recompute_every == 0
        if renewed:
            tested = saved(tests(pairs, cfg))
            s = similarity(tested, cfg)
            if propagate:
                labels = saved(propagated(pairs, s, index, sizes, cfg))
        if detailed:
            metrics[-1] |= runlog.stated(pairs, params, seen, cfg, s=s, tested=tested if renewed else None, labels=labels if renewed else None, seconds=time.time() - began)
        if settled:
            break
    return Refined(pairs, params, tested, s, labels, metrics)
