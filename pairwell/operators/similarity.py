"""Similarity of alleles: contingency tables of their calls, exact tests, false discovery, log odds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import bits
from ..functions.fisher import conservative_odds_ratio, fisher, odds_ratio
from ..sources.ship import ship
from ..sources.tables import saved
from .quantiles import quantiles

#: Pairs of a block of clusters, about, and alleles of a tile.
BLOCK, TILE = 1 << 17, 1024
_CELLS = "h1 int, h2 int, a long, b long, c long, d long, shared long"


def contingency(pairs: DataFrame, min_shared: int = 0) -> DataFrame:
    """h1 < h2, a, b, c, d, shared of alleles with calls in the same clusters.

    A product of bit matrices: clusters are dealt into blocks of some BLOCK pairs, alleles into tiles of
    TILE. A task gets two tiles of a block, packs observations and calls of an allele into words, and counts
    the bits that two alleles share. A block leaves at most a row for two alleles however many of
    its clusters hold both, and a task adds up those of its blocks, so at most H * (H - 1) / 2 rows a
    task are shuffled. More pairs make more blocks, never larger ones: a task's Python holds one. A pair
    goes to as many tasks as there are tiles (one up to TILE alleles).
    """
    ship(pairs.sparkSession)
    last = pairs.agg(F.count("*"), F.coalesce(F.max("hla_idx"), F.lit(0))).first()
    blocks, tiles = -(-last[0] // BLOCK) or 1, last[1] // TILE + 1
    block, tile, other = F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)), F.floor(F.col("hla_idx") / TILE), F.col("other")
    task = (block * tiles + F.least(tile, other)) * tiles + F.greatest(tile, other)  # one number, which Spark sorts by radix
    seen = 2 * F.col("hla_idx") + F.col("b_call").cast("boolean").cast("int")
    dealt = pairs.select("cluster_id", "hla_idx", "b_call", F.explode(F.array(*[F.lit(k).cast("long") for k in range(tiles)])).alias("other")).select(task.alias("task"), "cluster_id", seen.alias("seen"))

    def count(group: pa.Table) -> pa.Table:
        i, j = divmod(group["task"][0].as_py() % tiles**2, tiles)
        cluster, seen = (group[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("cluster_id", "seen"))
        allele, call = seen >> 1, (seen & 1).astype(bool)
        here = allele // TILE
        left = tuple(x[here == i] for x in (allele, cluster, call))
        right = left if i == j else tuple(x[here == j] for x in (allele, cluster, call))
        columns = bits.cells(left, right) if len(left[0]) and len(right[0]) else [np.empty(0, np.int64)] * 7
        return pa.Table.from_arrays([pa.array(x.astype(np.int32 if k < 2 else np.int64)) for k, x in enumerate(columns)], names=[c.split()[0] for c in _CELLS.split(", ")])

    parts = dealt.groupBy("task").applyInArrow(count, _CELLS)
    cells = parts.groupBy("h1", "h2").agg(*[F.sum(c).alias(c) for c in ("a", "b", "c", "d", "shared")])
    return cells.where(F.col("shared") >= min_shared)


def adjusted(tests: DataFrame, fdr: float) -> DataFrame:
    """tests with pvalue_adj (Benjamini-Hochberg) and significant.

    Equal p-values are one row with their number, so ties stay together. The rows are dealt into ranges;
    ranks run inside a range from the number of all before it, and so do the least scaled values from
    those behind it. Only a row a range (as many as shuffle partitions) is compared with all others.
    """
    values = tests.groupBy("pvalue").agg(F.count("*").alias("_n")).repartitionByRange("pvalue").withColumn("_range", F.spark_partition_id())
    values = saved(values)
    up = Window.partitionBy("_range").orderBy("pvalue").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("_range").orderBy(F.desc("pvalue")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = values.groupBy("_range").agg(F.sum("_n").alias("_size"))
    pairs = ends.crossJoin(ends.select(F.col("_range").alias("_other"), F.col("_size").alias("_more")))  # a row a range on both sides
    bases = pairs.groupBy("_range").agg(F.coalesce(F.sum(F.when(F.col("_other") < F.col("_range"), F.col("_more"))), F.lit(0)).alias("_base"), F.sum("_more").alias("_all"))
    ranked = values.join(F.broadcast(bases), "_range").select("pvalue", "_range", (F.col("pvalue") * F.col("_all") / (F.col("_base") + F.sum("_n").over(up))).alias("_scaled"))
    ranked = saved(ranked)
    least = ranked.groupBy("_range").agg(F.min("_scaled").alias("_least"))
    behind = least.select("_range").join(least.select(F.col("_range").alias("_other"), "_least"), F.col("_other") > F.col("_range"), "left").groupBy("_range").agg(F.min("_least").alias("_behind"))
    adjusted_values = ranked.join(F.broadcast(behind), "_range").select("pvalue", F.least(F.lit(1.0), F.min("_scaled").over(down), F.col("_behind")).alias("pvalue_adj"))
    return tests.join(adjusted_values, "pvalue").select(*tests.columns, "pvalue_adj", (F.col("pvalue_adj") < fdr).alias("significant"))


def tests(pairs: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The tested pairs of alleles: h1, h2, cells, shared, odds ratios, p-values; or_degenerate where the ratio is set."""
    ship(pairs.sparkSession)
    out = contingency(pairs, cfg.min_shared).select("*", odds_ratio().alias("OR"), (F.col("b") * F.col("c") == 0).alias("or_degenerate"), fisher("a", "b", "c", "d").alias("pvalue"), conservative_odds_ratio().alias("OR_conservative"))
    return adjusted(saved(out), cfg.fdr)


def mirrored(tested: DataFrame, *columns: str) -> DataFrame:
    """tested with both orders of each pair."""
    return tested.select("h1", "h2", *columns).unionByName(tested.select(F.col("h2").alias("h1"), F.col("h1").alias("h2"), *columns))


def similarity(tested: DataFrame, cfg: EngineConfig) -> DataFrame:
    """h1, h2, s of significant pairs in both orders: the log odds ratio; all others are 0 and left out."""
    ratio = "OR_conservative" if cfg.conservative_or else "OR"
    found = tested.where("significant").withColumn("s", F.ln(F.greatest(F.col(ratio), F.lit(1e-10))))
    return mirrored(found, "s")


def similarity_counts(s: DataFrame) -> DataFrame:
    """n_nonzero, n_positive, n_negative, n_near_zero of the upper triangle."""
    x = F.col("s")
    return s.where("h1 < h2").agg(F.count_if(x != 0).alias("n_nonzero"), F.count_if(x > 0).alias("n_positive"), F.count_if(x < 0).alias("n_negative"), F.count_if(F.abs(x) <= 1e-8).alias("n_near_zero"))


def matrix_long(tested: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """row_name, col_name, value of all pairs of alleles: 1 where untested, null on the diagonal."""
    rows, cols = index.select(F.col("hla_idx").alias("h1"), F.col("hla_name").alias("row_name")), index.select(F.col("hla_idx").alias("h2"), F.col("hla_name").alias("col_name"))
    grid = rows.crossJoin(cols)  # the matrix itself: H * H cells of the dictionary
    value = F.when(F.col("h1") == F.col("h2"), F.lit(None)).otherwise(F.coalesce(column, F.lit(1.0)))
    return grid.join(mirrored(tested, column), ["h1", "h2"], "left").select("row_name", "col_name", value.alias("value"))


def similarity_long(s: DataFrame, index: DataFrame) -> DataFrame:
    """row_name, col_name, value of the similarity of all pairs of alleles; 0 where none was found."""
    rows, cols = index.select(F.col("hla_idx").alias("h1"), F.col("hla_name").alias("row_name")), index.select(F.col("hla_idx").alias("h2"), F.col("hla_name").alias("col_name"))
    return rows.crossJoin(cols).join(s, ["h1", "h2"], "left").select("row_name", "col_name", F.coalesce("s", F.lit(0.0)).alias("value"))  # H * H cells


def matrix_wide(tested: DataFrame, index: DataFrame, column: str, names: list[str]) -> DataFrame:
    """row_name and a column for each of names."""
    return matrix_long(tested, index, column).groupBy("row_name").pivot("col_name", names).agg(F.first("value"))


def associations(tested: DataFrame, index: DataFrame) -> DataFrame:
    """hla_idx, hla_name, n_tested, n_significant; a pair counts for both."""
    ends = tested.select(F.explode(F.array("h1", "h2")).alias("hla_idx"), "significant").groupBy("hla_idx").agg(F.count("*").alias("n_tested"), F.count_if("significant").alias("n_significant"))
    return index.join(ends, "hla_idx", "left").na.fill(0, ["n_tested", "n_significant"])


def colour_scale(tested: DataFrame) -> DataFrame:
    """p95 of |log10 OR| that isn't 0, over both triangles; 1 without any."""
    log = F.abs(F.log10(F.greatest(F.col("OR"), F.lit(1e-10))))
    found = quantiles(mirrored(tested, "OR").select(log.alias("x")).where("x > 0"), [], ["x"], [0.95])
    return found.select(F.coalesce(F.col("x")[0], F.lit(1.0)).alias("p95_abs_log10_or"))
