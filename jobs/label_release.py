"""Releases denoised and propagated labels of (part, nation) pairs from the order tables, a folder a nation.

    spark-submit jobs/label_release.py --tables s3://.../tables --out s3://.../release --config jobs/label_release.json

Lines of orders are the observations: parts are the clusters, the nations of their suppliers the
categories, and an expression of the config file says which lines are positive. The engine estimates each nation's
error rates, calls the observed pairs, compares the nations, and fills unobserved pairs of the rare ones. Left behind:

    out/observed/allele=<a>     cluster_id, n_pos, n_neg, n_total, gamma, b_call
    out/propagated/allele=<a>   cluster_id, p_tilde, n_tilde, lambda_w
    out/tests                   the compared nations: cells, odds ratios, p-values
    out/log                     one JSON line: what was read and written

Before anything is written the counts must add up to the lines (gate); otherwise the release as it was
stays. A rerun replaces what it wrote before and gives the same. With `only`, a prefix of names, all
nations take part in the estimates but only the named ones' folders are replaced. Lines without part or
supplier, or whose supplier or nation is unknown, are no observations, and are counted as left out.
"""

from __future__ import annotations

import argparse
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from pairwell.config import EngineConfig
from pairwell.operators import counts, noise, propagate, similarity
from pairwell.sources.tables import dropped, saved

#: Settings of the config file: the positive lines (an expression over the joined tables), the nations to replace, how many members a part counts for each of its suppliers, and the engine's knobs.
DEFAULTS = {"positive": "l_returnflag = 'R'", "only": None, "members_per_supplier": 4, "engine": {}}


def suppliers(spark: SparkSession, tables: str) -> DataFrame:
    """Suppliers with their nations; null names where there is none."""
    read = lambda name, *columns: spark.read.parquet(f"{tables}/{name}.parquet").select(*columns)
    supplier, nation = read("supplier", "s_suppkey", "s_nationkey"), read("nation", "n_nationkey", "n_name", "n_regionkey")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")


def run(spark: SparkSession, tables: str, out: str, config: str | dict | None = None) -> dict:
    """Make the release; returns its log."""
    cfg = DEFAULTS | config if isinstance(config, dict) else common.read_config(spark, config, DEFAULTS)
    engine = EngineConfig(**{"sample_theta": False, **cfg["engine"]})
    line, part, known = spark.read.parquet(f"{tables}/lineitem.parquet"), F.col("l_partkey").cast("long"), F.col("n_name").isNotNull()
    # a row a supplier tells what is left out and which nations are observed, so that pairs have their numbers from the start
    heard = saved(line.groupBy("l_suppkey").agg(F.count("*").alias("n_lines"), F.count(part).alias("n_usable")).join(suppliers(spark, tables), F.col("l_suppkey") == F.col("s_suppkey"), "left"))
    index = saved(counts.allele_index(heard.where(known & (F.col("n_usable") > 0)).select(F.col("n_name").alias("allele"))))
    of = saved(heard.join(F.broadcast(index), F.col("n_name") == F.col("hla_name")).drop("l_suppkey", "n_lines", "n_usable", "hla_name"))
    usable = line.where(part.isNotNull()).join(of, F.col("l_suppkey") == F.col("s_suppkey"))
    label = F.coalesce(F.expr(cfg["positive"]), F.lit(False)).cast("long")
    sums = saved(usable.select(part.alias("cluster_id"), "hla_idx", label.alias("label")).groupBy("cluster_id", "hla_idx").agg(F.sum("label").alias("n_pos"), F.count("*").alias("n_total")))
    n_read, left_out = line.count(), heard.agg(F.coalesce(F.sum(F.when(known, F.col("n_lines") - F.col("n_usable")).otherwise(F.col("n_lines"))), F.lit(0))).first()[0]
    total = sums.agg(F.coalesce(F.sum("n_total"), F.lit(0)), F.count("*")).first()
    if total[0] + left_out != n_read:
        raise ValueError(f"{n_read} lines, but {total[0]} counted and {left_out} left out")
    # read only if there is something to propagate
    sizes = usable.select(part.alias("cluster_id"), "l_suppkey").groupBy("cluster_id").agg((cfg["members_per_supplier"] * F.count_distinct("l_suppkey")).alias("n_members"))
    pairs = sums.select("cluster_id", "hla_idx", "n_pos", (F.col("n_total") - F.col("n_pos")).alias("n_neg"), "n_total")
    rates = counts.binder_rates(pairs, index, engine)
    params = saved(noise.noise_params(pairs, index, engine).join(rates.select("hla_idx", "p_h"), "hla_idx"))
    called = noise.called(pairs, params, engine)  # not saved: making it again costs less than its columns
    tested = saved(similarity.tests(called, engine))
    labels = propagate.propagated(called, similarity.similarity(tested, engine), index, sizes, engine)

    def named(rows: DataFrame, *columns) -> DataFrame:
        found = rows.join(F.broadcast(index.select("hla_idx", F.col("hla_name").alias("allele"))), "hla_idx")
        return (found.where(F.col("allele").startswith(cfg["only"])) if cfg["only"] else found).select(*columns, "allele")

    some = bool(cfg["only"])
    common.write_partitions(named(called, "cluster_id", "n_pos", "n_neg", "n_total", F.col("gamma64").alias("gamma"), "b_call"), f"{out}/observed", "allele", only_given=some)
    common.write_partitions(named(labels, "cluster_id", "p_tilde", "n_tilde", "lambda_w"), f"{out}/propagated", "allele", only_given=some)
    tested.write.mode("overwrite").parquet(f"{out}/tests")
    n_observed, n_propagated = (spark.read.schema("cluster_id long, allele string").parquet(f"{out}/{kind}").count() for kind in ("observed", "propagated"))  # by the files' footers
    done = common.record(spark, f"{out}/log", {"lines": n_read, "left_out": left_out, "pairs": total[1], "observed": n_observed, "propagated": n_propagated, "only": cfg["only"]})
    dropped(heard, index, of, sums, params, tested)
    return done


def main(argv: list[str] | None = None) -> None:
    import logging

    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("tables", "out"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("label release").getOrCreate()
    try:
        run(spark, given.tables, given.out, given.config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
