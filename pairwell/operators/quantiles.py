"""Exact quantiles of groups by refining histograms: no task holds more of a group than its bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dropped, saved

#: Bins that a range is cut into at a time.
BINS = 512


def quantiles(rows: DataFrame, keys: list[str], columns: list[str], shares: list[float]) -> DataFrame:
    """keys and, for each of columns, an array with its quantiles at shares, interpolated between neighbours.

    A rank's value is found by histograms of the range it must lie in: the least and greatest values of
    the bin that holds the rank are the next range, until they are equal. Each round reads the values
    once and leaves at most BINS rows for each range still open, of which a group has two for each share. Values far apart
    in size take more rounds (every round narrows a range BINS times). Nulls and NaN count for nothing; a group
    without values has a null array, one of several columns may. Groups are as many as their keys: the
    ranges are small beside the rows, and Spark broadcasts them while they are.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    value = lambda c: F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_x"))
    long = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.explode(F.array(*[value(c) for c in columns])).alias("v"))
    long = saved(long.select(*names, "v.*").where("_x is not null and not isnan(_x)"))
    on = [*names, "_column"]
    bounds = long.groupBy(*on).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    place = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    ends = F.array(*[f(place(p)).cast("long") for p in shares for f in (F.floor, F.ceil)])
    targets = bounds.select(*on, "_n", "_low", "_high", F.lit(0).cast("long").alias("_before"), F.explode(F.array_distinct(ends)).alias("_rank"))
    targets, kept = saved(targets), []
    while True:
        kept.append(targets)
        still = targets.where("_low < _high")
        if still.isEmpty():
            break
        targets = saved(_narrowed(long, still, on).unionByName(targets.where("_low = _high")))
    found = targets.groupBy(*on).agg(F.first("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_low"))).alias("_at"))  # two entries a share

    def at(p: float) -> Column:
        low, high = F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")
        share = place(p) - low
        return F.try_element_at("_at", low) * (1 - share) + F.try_element_at("_at", high) * share

    out = found.select(*on, F.array(*[at(p) for p in shares]).alias("_q"))
    wide = out.groupBy(*names).agg(*[F.first(F.when(F.col("_column") == c, F.col("_q")), ignorenulls=True).alias(c) for c in columns])
    wide = saved(wide.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], *columns))
    dropped(long, *kept)
    return wide


def _narrowed(long: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """targets with the range and the rank of the bin that holds their rank."""
    ranges = targets.select(*on, "_low", "_high", "_before").distinct()
    inside = long.join(ranges, on).where(F.col("_x").between(F.col("_low"), F.col("_high")))
    place = F.least(F.floor((F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS), F.lit(BINS - 1)).cast("int")
    bins = inside.groupBy(*on, "_low", "_before", place.alias("_bin")).agg(F.count("*").alias("_count"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    order = Window.partitionBy(*on, "_low").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*on, "_low", "_least", "_most", "_count", (F.col("_before") + F.coalesce(F.sum("_count").over(order), F.lit(0))).alias("_start"))
    met = targets.join(bins, [*on, "_low"]).where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_count")))
    return met.select(*on, "_n", F.col("_least").alias("_low"), F.col("_most").alias("_high"), F.col("_start").alias("_before"), "_rank")


def with_medians(grouped: DataFrame, rows: DataFrame, keys: list[str], medians: dict[str, str]) -> DataFrame:
    """grouped (a row a group of rows by keys) with the medians of columns under new names."""
    found = quantiles(rows, keys, list(medians), [0.5])
    named = found.select(*[F.col(k).alias(f"_on{i}") for i, k in enumerate(keys)], *[F.col(c)[0].alias(n) for c, n in medians.items()])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_on{i}"))
    return grouped.join(named, same, "left").drop(*[f"_on{i}" for i in range(len(keys))])
