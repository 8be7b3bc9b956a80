"""What the operators share: the package on the executors, and tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the filter that without() broadcasts, 64 bits each.
FILTER_BLOCKS = 1 << 16

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="pairwell-code-")  # executors fetch it from the driver until the end
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "pairwell_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; a folder of this machine only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "pairwell-shared")
    return f"{base.rstrip('/')}/pairwell-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of save() that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.saved_at)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bitmap(bits: DataFrame, size: int) -> np.ndarray:
    """The bitmap (bytes) of 2 ** size bits with the column `bit` set; at most 2 ** (size - 6) words come to the driver, as Arrow."""
    word = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    words = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(word).alias("word")).toArrow()
    out = np.zeros(max(1, 1 << max(0, size - 6)), np.int64)
    out[words["at"].to_numpy()] = words["word"].to_numpy()
    return out.view(np.uint8)


def _mask(h: Column) -> Column:
    """Three bits of a 64-bit block, from three parts of a hash."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int")) for k in (0, 6, 12)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def without(docs: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """The rows of docs whose keys (longs) are not a row of gone (as many longs), with their columns.

    A blocked Bloom filter of gone, a table of at most FILTER_BLOCKS rows, lets nearly all rows that
    stay pass without a shuffle of their texts; only possible hits meet gone itself. However many rows
    are gone, the result is exact: a full filter only sends more rows to the join.
    """
    names = [f"_key{k}" for k in range(len(keys))]
    gone = gone.toDF(*names)
    h, block = F.xxhash64(*names), lambda h: F.pmod(F.shiftrightunsigned(h, 20), F.lit(FILTER_BLOCKS))
    filled = gone.groupBy(block(h).alias("_block")).agg(F.bit_or(_mask(h)).alias("_mask"))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    keyed = docs.select(row, *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    tried = keyed.withColumn("_block", block(h)).join(F.broadcast(filled), "_block", "left")
    hit = F.coalesce(F.col("_mask").bitwiseAND(_mask(h)) == _mask(h), F.lit(False))
    doubtful = tried.where(hit).select("_row", *names).join(gone, names, "left_anti")
    return tried.where(~hit).select("_row.*").unionByName(doubtful.select("_row.*"))
