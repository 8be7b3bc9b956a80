"""Observations, members and logs derived from the driver's tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The names in the driver's table of nations.
NATIONS = ("NATION_0", "NATION_1", "NATION_10", "NATION_11", "NATION_12", "NATION_13", "NATION_14", "NATION_15", "NATION_16", "NATION_17", "NATION_18", "NATION_19", "NATION_2", "NATION_20", "NATION_21", "NATION_22", "NATION_23", "NATION_24", "NATION_3", "NATION_4", "NATION_5", "NATION_6", "NATION_7", "NATION_8", "NATION_9")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hash2(*columns: str):
    return F.substring(F.md5(F.concat_ws("|", *columns).cast("binary")), 1, 2)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster_id (part), allele (nation of the supplier), label: alleles of a region share a hidden truth."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    truth, flip = _hash2("l_partkey", "n_regionkey") < "40", _hash2("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey") < "0d"
    return joined.select(F.col("l_partkey").alias("cluster_id"), F.col("n_name").alias("allele"), (truth != flip).cast("int").alias("label"))


def planted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster_id, n_members: four times the suppliers of a part."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cluster_id"))
    return lines.agg((4 * F.count_distinct("l_suppkey")).alias("n_members"))


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, long_mer, allele (source): words of documents, as residues."""
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,14}"), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", "source", words.alias("w")).select("doc_id", F.translate(F.upper("w"), "BJOUXZ", "DLKCGE").alias("long_mer"), F.col("source").alias("allele"))


def labelled_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """long_mer, allele, assigned_label of labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("assigned_label"))
    return peptides(spark, sf_dir).join(labels, "doc_id").select("long_mer", "allele", "assigned_label")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster_id, sequence: distinct words, clustered by group of their first letter and length."""
    distinct = peptides(spark, sf_dir).select(F.col("long_mer").alias("sequence")).distinct().where(F.length("sequence") <= 12)
    number = 32 * (F.ascii(F.substring("sequence", 1, 1)) - 65) + F.length("sequence")
    return distinct.select(F.concat(F.lit("cluster_"), number.cast("string")).alias("cluster_id"), "sequence")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor, n, first: anchors of all words, ties by the anchor."""
    from ..functions.anchors import anchor

    return peptides(spark, sf_dir).groupBy(anchor(F.col("long_mer")).alias("anchor")).agg(F.count("*").alias("n")).withColumn("first", F.col("anchor"))


def exact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """header, sequence of distinct words; headers are the words."""
    return peptides(spark, sf_dir).select(F.col("long_mer").alias("header"), F.col("long_mer").alias("sequence")).distinct()
