"""Parameters of the engine, checked when made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """All knobs with their defaults."""

    allele_prefix: str | None = None
    peptide_col: str = "long_mer"
    allele_col: str = "allele"
    label_col: str = "assigned_label"
    normalize_case: bool = False  # upper-case observed sequences before they meet the clusters
    shrinkage_k: float = 50.0
    rate_floor: float = 0.001
    rate_ceil: float = 0.95
    alpha_prior: tuple[float, float] = (2.0, 18.0)
    beta_prior: tuple[float, float] = (1.0, 49.0)
    alpha_range: tuple[float, float] = (0.001, 0.40)
    beta_range: tuple[float, float] = (0.001, 0.15)
    noise_min_total: int = 5
    noise_purity: float = 0.90
    tau_multiplier: float = 2.0
    tau_max: float = 0.50
    fdr: float = 0.05
    min_shared: int = 10
    conservative_or: bool = True
    kappa: float = 10.0
    only_rare: bool = True
    rare_max_pairs: int = 5000  # number of (cluster, allele) pairs, which is what is compared
    coverage_tau: float = 0.5
    max_iter: int = 0
    tol: float = 1e-3
    recompute_every: int = 3
    sample_theta: bool = True
    seed: int = 0
    feedback_weight: float = 100.0

    def __post_init__(self):
        if not 0 <= self.rate_floor < self.rate_ceil <= 1 or self.shrinkage_k < 0:
            raise ValueError("rates need 0 <= floor < ceil <= 1 and a shrinkage of 0 or more")
        if not 0 < self.fdr < 1 or not 0 <= self.noise_purity < 1 or self.min_shared < 0:
            raise ValueError("fdr and purity are shares, min_shared is a count")
        if self.recompute_every < 1 or self.max_iter < 0 or self.tol < 0:
            raise ValueError("iterations and tolerance can't be negative")
