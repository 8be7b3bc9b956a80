"""Readers: tables by suffix, sequences, cluster files, logs. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig

CLUSTERS = "cluster_id string, representative_anchor string, peptide_header string, sequence string, anchor string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether path is there, in whatever store Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether path is one file and no folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile())


def required(spark: SparkSession, *paths: str) -> None:
    """Raises FileNotFoundError for the first path that isn't there."""
    for path in paths:
        if not exists(spark, path):
            raise FileNotFoundError(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, CSV or TSV (.tsv, .txt), by the suffix; schema names and types the columns to read."""
    suffix = path.rstrip("/").rsplit("/", 1)[-1].lower().rpartition(".")[2]
    if suffix == "parquet":
        frame = spark.read.parquet(path)
        return frame if schema is None else frame.select(*[F.col(f.name).cast(f.dataType) for f in _fields(schema)])
    if suffix not in ("csv", "tsv", "txt"):
        raise ValueError(f"no reader for {path}")
    reader = spark.read.option("header", True).option("sep", "," if suffix == "csv" else "\t").option("enforceSchema", False)
    raw = reader.csv(path)  # all columns as strings, by the header's names
    return raw if schema is None else raw.select(*[F.col(f.name).try_cast(f.dataType) for f in _fields(schema)])


def _fields(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def read_observations(spark: SparkSession, path: str, cfg: EngineConfig) -> DataFrame:
    """The three mapped columns."""
    return read_table(spark, path, f"`{cfg.peptide_col}` string, `{cfg.allele_col}` string, `{cfg.label_col}` int")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id, sequence of a cluster file."""
    return spark.read.option("header", True).option("sep", "\t").schema(CLUSTERS).csv(path).select("cluster_id", "sequence")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """rep, member of a two-column file without header."""
    return spark.read.option("sep", "\t").schema("rep string, member string").csv(path)


def read_fasta(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """ord, header (first word), sequence (lines joined; with one_line the first only); text before the first > is left out.

    ord orders records as they stand in a file (file, block, place in the block).
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "\r", "").alias("value"), place.alias("ord"))
    first = raw.groupBy(F.col("ord.file").alias("file")).agg(F.min("ord").alias("head"))
    marked = raw.join(first, raw["ord.file"] == first["file"])
    records = marked.where((F.col("ord") != F.col("head")) | F.col("value").startswith(">")).select("ord", F.regexp_replace("value", "^>", "").alias("value"))
    lines = F.split("value", "\n")
    body = F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x)), lambda x: x != "")
    sequence = F.coalesce(F.get(body, F.lit(0)), F.lit("")) if one_line else F.array_join(body, "")
    return records.select("ord", F.get(F.split(F.trim(F.get(lines, F.lit(0))), r"\s+"), F.lit(0)).alias("header"), sequence.alias("sequence"))


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """A result as parquet, else the CSV of the same name, else FileNotFoundError."""
    stem = path.removesuffix(".parquet").removesuffix(".csv")
    for suffix in (".parquet", ".csv"):
        if exists(spark, stem + suffix):
            return read_table(spark, stem + suffix)
    raise FileNotFoundError(stem + ".parquet")


def best_level1(spark: SparkSession, folder: str, run: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs and noise parameters: of the named run, else the refined ones if there are any."""
    for name in [run] if run is not None else ["_gibbs_final", "_em_final", ""]:
        if exists(spark, f"{folder}/level1_results{name}.parquet"):
            return read_result(spark, f"{folder}/level1_results{name}.parquet"), read_result(spark, f"{folder}/noise_params{name}.csv")
    raise FileNotFoundError(f"{folder}/level1_results.parquet")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """value: whole logs."""
    return spark.read.text(path, wholetext=True)
