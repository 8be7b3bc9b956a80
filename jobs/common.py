"""What the jobs share: config files read by Spark, partitioned writes, and one record of a run."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("pairwell.jobs")


def read_config(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """defaults with what the JSON file at path sets; a key that isn't a default is an error."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()) if path else "{}"  # one small file
    given = json.loads(text)
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def write_partitions(df: DataFrame, path: str, column: str, *, only_given: bool = False) -> None:
    """df as Parquet in a folder for each value of column.

    Rows are spread over tasks by column and then evenly, however hot a value is. With only_given the
    folders of other values stay as they are (dynamic partition overwrite), else all of path is replaced.
    """
    mode = "dynamic" if only_given else "static"
    df.hint("rebalance", column).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(column).parquet(path)


def record(spark: SparkSession, path: str, row: dict) -> dict:
    """Logs a run's numbers and writes them as one JSON line, replacing those of a rerun."""
    log.info("%s", json.dumps(row, sort_keys=True))
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return row
