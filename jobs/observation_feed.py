"""Keeps denoised calls of (anchor, source) pairs current while new files of labelled documents arrive.

    spark-submit jobs/observation_feed.py --documents s3://.../documents --labels s3://.../labels --out s3://.../feed

Words of documents are the sequences, their anchors the clusters, sources the categories and the
documents' labels the noisy observations. A run takes the files that have come since the last one (a file stream
with its checkpoint, until what is there is used up), and leaves

    out/deltas/batch=<n>   what each micro-batch counted: cluster_id, allele, n_pos, n_total
    out/calls/allele=<a>   all pairs so far, with their posterior and call, from the sums of the deltas
    out/rates              each allele's rate, error rates and threshold
    out/log/batch=<n>      what each micro-batch read and wrote
    out/mark               the last micro-batch that calls hold

Texts are read once. A micro-batch that is repeated after a failure replaces its own folder, and a run
that stopped between counting and calling is made good by the next one, which sees the mark behind the
deltas; a run that finds nothing new writes nothing. The checkpoint belongs to out: use both together.

Labels are looked up when a document arrives. A document without a label isn't an observation; it is
counted in the log as unlabelled and not taken later. Null texts and sources hold no observation. A
document that comes in two files is observed twice, as repeated assays are. With several labels for a
document each counts once.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from pairwell.config import EngineConfig
from pairwell.functions import anchors
from pairwell.operators import counts, noise
from pairwell.sources.readers import exists, is_file
from pairwell.streaming.counts import snapshot

#: Settings of the config file: what a word is, which column of labels is the observation, files a micro-batch takes, and the engine's knobs.
DEFAULTS = {"word": "[A-Za-z]{6,14}", "from_letters": "BJOUXZ", "to_letters": "DLKCGE", "label": "quality", "files_per_batch": 200, "engine": {}}


DELTA = "cluster_id string, allele string, n_pos long, n_total long"


def observations(documents: DataFrame, labels: DataFrame, cfg: dict, engine: EngineConfig) -> DataFrame:
    """cluster_id (anchor), allele, label of the words of labelled documents."""
    words = documents.select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(cfg["word"]), F.lit(0))).alias("w"))
    found = words.join(labels.select("doc_id", F.col(cfg["label"]).alias(engine.label_col)), "doc_id")
    raw = found.select(F.translate(F.upper("w"), cfg["from_letters"], cfg["to_letters"]).alias(engine.peptide_col), F.col("source").alias(engine.allele_col), engine.label_col)
    return counts.prepared(raw, engine).select(anchors.anchor(F.col("peptide")).alias("cluster_id"), "allele", "label").where("cluster_id is not null")


def count_batch(documents: DataFrame, labels: DataFrame, out: str, number: int, cfg: dict, engine: EngineConfig) -> None:
    """The counts of one micro-batch, under its number."""
    spark = documents.sparkSession
    at = f"{out}/deltas/batch={number}"
    counts.pair_sums(observations(documents, labels, cfg, engine)).write.mode("overwrite").parquet(at)
    unlabelled = documents.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti").count()
    # both counts are read from the files' footers
    common.record(spark, f"{out}/log/batch={number}", {"batch": number, "documents": documents.count(), "unlabelled": unlabelled, "pairs": spark.read.schema(DELTA).parquet(at).count()})


def publish(spark: SparkSession, out: str, engine: EngineConfig) -> int:
    """Calls of all pairs that the deltas hold; returns their number."""
    pairs = snapshot(spark.read.schema(DELTA).parquet(f"{out}/deltas"))
    pairs.write.mode("overwrite").parquet(f"{out}/_pairs")
    pairs = spark.read.schema(pairs.schema).parquet(f"{out}/_pairs")
    index = counts.allele_index(pairs)
    numbered = counts.indexed(pairs, index)
    rates = counts.binder_rates(numbered, index, engine)
    params = noise.with_tau(noise.noise_params(numbered, index, engine).join(rates, "hla_idx"), engine)
    params.join(index, "hla_idx").write.mode("overwrite").parquet(f"{out}/rates")
    params = spark.read.schema("hla_idx int, alpha double, beta double, p_h double").parquet(f"{out}/rates")
    called = noise.called(numbered, params, engine).join(F.broadcast(index), "hla_idx")
    common.write_partitions(called.select("cluster_id", "n_pos", "n_neg", "n_total", F.col("gamma64").alias("gamma"), "b_call", F.col("hla_name").alias("allele")), f"{out}/calls", "allele")
    return pairs.count()


def latest(spark: SparkSession, path: str) -> int:
    """The last number of a folder of batches, or of the mark; -1 without any."""
    if not exists(spark, path):
        return -1
    found = spark.read.text(path, wholetext=True)
    number = F.col("batch").cast("int") if "batch" in found.columns else F.col("value").cast("int")
    return found.agg(F.coalesce(F.max(number), F.lit(-1))).first()[0]


def run(spark: SparkSession, documents: str, labels: str, out: str, config: str | None = None, checkpoint: str | None = None) -> dict:
    """Take what is new, until it is used up; returns how many documents and micro-batches that were and how many pairs are called."""
    cfg = common.read_config(spark, config, DEFAULTS)
    engine = EngineConfig(**cfg["engine"])
    given = spark.read.parquet(labels).select("doc_id", cfg["label"])
    before = latest(spark, f"{out}/log")
    table = spark.read.parquet(documents).select("doc_id", "source", "text")
    # a file stream takes a folder; what lies in it by the name of a file is picked by a pattern
    folder, _, name = documents.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", cfg["files_per_batch"])
    stream = reader.option("pathGlobFilter", name).parquet(folder) if is_file(spark, documents) else reader.parquet(documents)

    def put(batch: DataFrame, number: int) -> None:
        # the stream's batches come with a session of their own; tables of the other one are read again there
        count_batch(batch, batch.sparkSession.read.schema(given.schema).parquet(labels), out, number, cfg, engine)

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint or f"{out}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = latest(spark, f"{out}/log")
    read = 0
    if last > before:
        logs = spark.read.text(f"{out}/log").where(F.col("batch") > before)
        read = int(logs.agg(F.sum(F.get_json_object("value", "$.documents").cast("long"))).first()[0])
    called = None
    if last > latest(spark, f"{out}/mark"):
        called = publish(spark, out, engine)
        spark.createDataFrame([(str(last),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/mark")
    done = {"documents": read, "batches": last - before, "pairs_called": called}
    common.log.info("observation feed: %s", json.dumps(done))
    return done


def main(argv: list[str] | None = None) -> None:
    import logging

    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "labels", "out"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    args.add_argument("--checkpoint")
    given = args.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("observation feed").getOrCreate()
    try:
        run(spark, given.documents, given.labels, given.out, given.config, given.checkpoint)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
