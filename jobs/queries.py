"""The jobs as queries: run twice into one new folder, the output read back; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import label_release, observation_feed
from pairwell.plans import oracle
from pairwell.sources.tables import shared_path

#: Lines that count as positive: suppliers of a region share a hidden truth of each part, told with errors.
PLANTED = "(substring(md5(cast(concat_ws('|', l_partkey, n_regionkey) AS binary)), 1, 2) < '40') <> (substring(md5(cast(concat_ws('|', l_orderkey, l_linenumber, l_suppkey, l_partkey) AS binary)), 1, 2) < '0d')"


def job1_observation_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark)
    for _ in range(2):
        observation_feed.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    calls = spark.read.schema("cluster_id string, n_pos long, n_neg long, n_total long, gamma double, b_call tinyint, allele string").parquet(f"{out}/calls")
    return calls.select("allele", "cluster_id", "n_pos", "n_neg", "n_total", F.round("gamma", 6).alias("gamma"), F.col("b_call").cast("int").alias("b_call"))


def job2_label_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark)
    for _ in range(2):
        label_release.run(spark, sf_dir, out, {"positive": PLANTED})
    observed = spark.read.schema("cluster_id long, n_pos long, n_neg long, n_total long, gamma double, b_call tinyint, allele string").parquet(f"{out}/observed")
    propagated = spark.read.schema("cluster_id long, p_tilde float, n_tilde float, lambda_w float, allele string").parquet(f"{out}/propagated")
    whole = observed.select("allele", "cluster_id", F.lit("observed").alias("kind"), F.round("gamma", 4).alias("value"), F.col("n_total").cast("double").alias("weight"))
    filled = propagated.select("allele", "cluster_id", F.lit("propagated").alias("kind"), F.round(F.col("p_tilde").cast("double"), 4).alias("value"), F.round(F.col("n_tilde").cast("double"), 4).alias("weight"))
    return whole.unionByName(filled)


QUERIES = {f.__name__: f for f in (job1_observation_feed, job2_label_release)}
ORACLE = {name: oracle.ORACLE[name] for name in QUERIES}
