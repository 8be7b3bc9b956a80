"""Writers of results."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import column_descriptions
from .ship import ship
from .tables import dropped, saved

#: Cells of a block of rows of a matrix, about.
CELLS = 1 << 18


def layout(root: str) -> dict[str, str]:
    """Folders of a run's outputs."""
    return {name: f"{root.rstrip('/')}/stage1/{name}" for name in ("level1", "level2", "level3", "diagnostics")}


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_ordered(df: DataFrame, path: str, order: list[str]) -> None:
    """A large table in order, over as many files as it has partitions."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def row_blocks(matrix: DataFrame, names: list[str]) -> DataFrame:
    """block, data: the matrix (row_name, col_name, value) as doubles in the order of names, some CELLS cells of whole rows at a time; cells without value are NaN."""
    ship(matrix.sparkSession)
    size, n = max(1, CELLS // max(len(names), 1)), len(names)
    places = matrix.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, place int")  # a dictionary
    rows, cols = (F.broadcast(places.select(F.col("name").alias(f"{k}_name"), F.col("place").alias(k))) for k in ("row", "col"))
    cells = matrix.join(rows, "row_name").join(cols, "col_name").select(F.floor(F.col("row") / size).cast("int").alias("block"), "row", "col", "value")

    def filled(group: pa.Table) -> pa.Table:
        row, col, block = (group[c].to_numpy() for c in ("row", "col", "block"))
        first = int(block[0]) * size
        out = np.full((min(size, n - first), n), np.nan)
        out[row - first, col] = group["value"].to_numpy()
        return pa.table({"block": pa.array([int(block[0])], pa.int32()), "data": pa.array([out.astype("<f8").tobytes()], pa.binary())})

    return cells.groupBy("block").applyInArrow(filled, "block int, data binary")


def write_npy(matrix: DataFrame, names: list[str], path: str) -> None:
    """A matrix as one .npy file, byte for byte as numpy writes it, through any file system that Spark knows.

    Tasks make blocks of rows; the one file they go into is written by the driver, which holds a block at
    a time. The name appears when the file is whole.
    """
    spark, head = matrix.sparkSession, io.BytesIO()
    blocks = saved(row_blocks(matrix, names))
    np.lib.format.write_array_header_1_0(head, {"descr": "<f8", "fortran_order": False, "shape": (len(names), len(names))})
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    part, whole = hadoop(path + "._part"), hadoop(path)
    store = part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(part, True)
    try:
        out.write(bytearray(head.getvalue()))
        for r in blocks.orderBy("block").toLocalIterator():
            out.write(bytearray(r.data))
    finally:
        out.close()
    store.delete(whole, False)
    store.rename(part, whole)
    dropped(blocks)


def write_wide(matrix: DataFrame, names: list[str], path: str) -> None:
    """A matrix as CSV: a header, then a line a row in the order of names. Lines are made by tasks; no table of as many columns is planned."""
    spark = matrix.sparkSession
    places = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, place int")
    quoted = lambda c: F.to_csv(F.struct(c))
    rows, cols = (F.broadcast(places.select(F.col("name").alias(f"{k}_name"), F.col("place").alias(k))) for k in ("row", "col"))
    cells = matrix.join(rows, "row_name").join(cols, "col_name").groupBy("row", "row_name").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("v")))).alias("x"))  # a row of the matrix
    lines = cells.select("row", F.concat(quoted("row_name"), F.lit(","), F.array_join(F.transform("x", lambda e: e["v"]), ",")).alias("value"))
    head = places.groupBy().agg(F.array_sort(F.collect_list(F.struct("place", quoted("name").alias("v")))).alias("x"))
    head = head.select(F.lit(-1).alias("row"), F.concat(F.lit("row_name,"), F.array_join(F.transform("x", lambda e: e["v"]), ",")).alias("value"))
    head.unionByName(lines).orderBy("row").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_matrix(matrix: DataFrame, names: list[str], path: str) -> None:
    """row_name, col_name, value as <path>.npy and as <path>_wide.csv with a column an allele, however many there are."""
    write_npy(matrix, names, path + ".npy")
    write_wide(matrix, names, path + "_wide.csv")


def write_csv(df: DataFrame, path: str, order: list | None = None, sep: str = ",") -> None:
    """A small table (one row an allele, or a pair of them) as one file with a header."""
    ordered = df.orderBy(*order) if order else df
    ordered.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """A large table, in as many files as it has partitions."""
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_fasta(members: DataFrame, path: str, least: int = 1) -> None:
    """A folder for each cluster of at least `least` members (cluster_id, header, sequence)."""
    big = members.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cluster_id")
    text = F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("sequence"))
    members.join(big, "cluster_id").select("cluster_id", text.alias("value")).write.mode("overwrite").partitionBy("cluster_id").text(path)


def write_short(short: DataFrame, path: str) -> None:
    """Sequences that are too short for an anchor."""
    short.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("sequence")).alias("value")).write.mode("overwrite").text(path)


def write_log(spark: SparkSession, text: str, path: str) -> None:
    """The log of a run as one text file, in a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_log_table(table: DataFrame, path: str) -> dict[str, str]:
    """The table's columns in order of their names as CSV; returns their descriptions, written beside it as JSON."""
    columns = sorted(table.columns)
    write_csv(table.select(*columns), path, ["iteration"])
    said = column_descriptions(columns)
    table.sparkSession.createDataFrame([(json.dumps(said, indent=4),)], "value string").coalesce(1).write.mode("overwrite").text(path + "_columns")
    return said
