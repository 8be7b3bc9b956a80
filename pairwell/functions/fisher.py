"""Fisher's exact test, two-sided, and odds ratios of 2x2 tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Tables as probable as the observed one up to this log difference count as ties.
TIE = 1e-7
#: Tables of the same margins in a row of fisher_by_rows().
PIECE = 4096
_HALF_LOG_TAU = 0.9189385332046727


def log_factorial(n: Column) -> Column:
    """ln n! of an integer: the product below 21, else Stirling's series (error below 1e-15)."""
    x = (n + 1).cast("double")
    inverse = 1.0 / x
    series = inverse * (1 / 12.0 - inverse * inverse * (1 / 360.0 - inverse * inverse * (1 / 1260.0 - inverse * inverse / 1680.0)))
    large = (x - 0.5) * F.ln(x) - x + _HALF_LOG_TAU + series
    return F.when(n <= 20, F.ln(F.factorial(F.greatest(n, F.lit(0)).cast("int")).cast("double"))).otherwise(large)


def fisher_by_rows(tables: DataFrame, keys: list[str]) -> DataFrame:
    """tables (keys, a, b, c, d) with pvalue, by all tables of the same margins, in rows of PIECE of them.

    The pieces of a support are dealt to all tasks, and each is folded from its first table on by the ratio of
    neighbouring ones, so memory doesn't grow with the counts. The work does, in proportion; fisher()
    sums only what weighs anything.
    """
    r1, r2, c1 = F.col("a") + F.col("b"), F.col("c") + F.col("d"), F.col("a") + F.col("c")
    open_margin = (r1 > 0) & (r2 > 0) & (c1 > 0) & (F.col("b") + F.col("d") > 0)
    low, high = F.greatest(F.lit(0).cast("long"), c1 - r2).cast("long"), F.least(r1, c1).cast("long")
    logs = lambda k: -sum((log_factorial(p) for p in (F.col("r1") - k, F.col("c1") - k, F.col("r2") - F.col("c1") + k)), log_factorial(k))
    fixed = log_factorial(F.col("r1")) + log_factorial(F.col("r2")) + log_factorial(F.col("c1")) + log_factorial(F.col("r1") + F.col("r2") - F.col("c1")) - log_factorial(F.col("r1") + F.col("r2"))
    each = tables.where(open_margin).select(*keys, "a", r1.alias("r1"), r2.alias("r2"), c1.alias("c1"), low.alias("_low"), high.alias("_high"))
    each = each.select(*keys, "r1", "r2", "c1", "_high", logs(F.col("a")).alias("_seen"), fixed.alias("_fixed"), F.explode(F.sequence("_low", "_high", F.lit(PIECE).cast("long"))).alias("_from"))
    pieces = each.repartition(int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_from")  # by number: they are few bytes, but much work
    a, b, c, d = (lambda k: k.cast("double")), (lambda k: (F.col("r1") - k).cast("double")), (lambda k: (F.col("c1") - k).cast("double")), (lambda k: (F.col("r2") - F.col("c1") + k).cast("double"))
    start = F.struct(logs(F.col("_from")).alias("lp"), F.lit(0.0).alias("p"))
    counts = lambda x: F.when(x["lp"] <= F.col("_seen") + TIE, F.exp(x["lp"] + F.col("_fixed"))).otherwise(0.0)
    step = lambda x, k: F.struct((x["lp"] + F.ln(b(k) * c(k) / (a(k + 1) * d(k + 1)))).alias("lp"), (x["p"] + counts(x)).alias("p"))
    last = F.least(F.col("_from") + (PIECE - 1), F.col("_high"))
    sums = pieces.select(*keys, F.aggregate(F.sequence("_from", last), start, step)["p"].alias("_p"))
    summed = sums.groupBy(*keys).agg(F.least(F.lit(1.0), F.sum("_p")).alias("pvalue"))
    return tables.join(summed, keys, "left").na.fill(1.0, ["pvalue"])


def _stirling(n: np.ndarray) -> np.ndarray:
    x = n.astype(np.float64) + 1
    small = x < 21
    i = 1 / np.where(small, 21.0, x)
    out = (x - 0.5) * np.log(np.where(small, 21.0, x)) - x + _HALF_LOG_TAU + i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i / 1680)))
    table = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 21)))))
    return np.where(small, table[np.minimum(n, 20).astype(int)], out)


def two_sided(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    """The p-values of tables, `most` tables of the same margins at a time, whichever they belong to.

    Only tables within 60 standard deviations of the mode are summed; others weigh nothing.
    """
    a, b, c, d = (np.asarray(x, np.int64) for x in (a, b, c, d))
    r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
    out, some = np.ones(len(a)), np.flatnonzero((r1 > 0) & (r2 > 0) & (c1 > 0) & (n > c1))
    r1, r2, c1, n, a = (x[some] for x in (r1, r2, c1, n, a))
    mode = (r1 + 1) * (c1 + 1) // (n + 2)
    reach = (60 * np.sqrt(r1 * (r2 / n) * (c1 / n) * ((n - c1) / np.maximum(1, n - 1)))).astype(np.int64) + 60
    low, high = np.maximum(np.maximum(0, c1 - r2), mode - reach), np.minimum(np.minimum(r1, c1), mode + reach)
    weight = lambda k, r1, c1, r2: -(_stirling(k) + _stirling(r1 - k) + _stirling(c1 - k) + _stirling(r2 - c1 + k))
    seen = weight(a, r1, c1, r2)
    fixed = _stirling(r1) + _stirling(r2) + _stirling(c1) + _stirling(n - c1) - _stirling(n)
    ends, p = np.cumsum(high - low + 1), np.zeros(len(some))
    starts, total = ends - (high - low + 1), int(ends[-1]) if len(ends) else 0
    for lo in range(0, total, most):
        hi = min(lo + most, total)
        first, last = np.searchsorted(ends, (lo, hi - 1), "right")
        t = np.arange(first, last + 1)
        cut = np.maximum(starts[t], lo)
        of = np.repeat(t, np.minimum(ends[t], hi) - cut)
        lp = weight(low[of] + np.arange(lo, hi) - starts[of], r1[of], c1[of], r2[of])
        p[t] += np.add.reduceat(np.where(lp <= seen[of] + TIE, np.exp(lp + fixed[of]), 0.0), cut - lo)
    out[some] = np.where((a < low) | (a > high), 0.0, np.minimum(1.0, p))
    return out


@F.pandas_udf(DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p-values of tables."""
    return pd.Series(two_sided(a, b, c, d), dtype="float64")


def odds_ratio() -> Column:
    """ad / bc; 1 where a cell of the divisor is 0."""
    return F.when(F.col("b") * F.col("c") == 0, F.lit(1.0)).otherwise(F.try_divide((F.col("a") * F.col("d")).cast("double"), F.col("b") * F.col("c")))


def conservative_odds_ratio() -> Column:
    """The lower 95% bound of the odds ratio with half a count added to each cell, at least 1."""
    a, b, c, d = (F.col(x) + F.lit(0.5) for x in "abcd")
    return F.greatest(F.lit(1.0), F.exp(F.ln(a * d / (b * c)) - 1.96 * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)))
