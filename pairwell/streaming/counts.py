"""Pair counts kept up to date from a stream of observations (an extension; counts are associative)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def batch_counts(rows: DataFrame) -> DataFrame:
    """cluster_id, allele, n_pos, n_total of a batch."""
    return rows.groupBy("cluster_id", "allele").agg(F.sum(F.col("label").cast("long")).alias("n_pos"), F.count("*").alias("n_total"))


def maintain(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's counts under its number, which makes a repeated batch replace itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch_counts(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(counts: DataFrame) -> DataFrame:
    """cluster_id, allele, n_pos, n_neg, n_total over all batches."""
    total = counts.groupBy("cluster_id", "allele").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_total").alias("n_total"))
    return total.withColumn("n_neg", F.col("n_total") - F.col("n_pos"))
