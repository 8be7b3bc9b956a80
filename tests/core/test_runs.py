"""Whole runs from files, the commands, and the stream of counts."""

import numpy as np
from pyspark.sql import functions as F

from pairwell import __main__ as command
from pairwell.config import EngineConfig
from pairwell.plans import fixtures, pipeline
from pairwell.streaming import counts as stream

LOG = """start
--- Gibbs Iteration 1/3 ---
  Sampled theta: 1,234/5,000 binders (24.68%)
  alpha: mean=0.0812, beta: mean=0.0193
  p_h: mean=0.2513, median=0.2401
  gamma: mean=0.2620, median=0.0312
  >0.5: 1,301/5,000
  tau_h: mean=0.4810, median=0.5000
  tau_max cap applied to 12/25 alleles
  Positive calls: 1,310/5,000 (26.20%)
  max|delta gamma| = 0.912345, mean|delta| = 0.012345
  Significant pairs: 50 / 300 (FDR < 0.05)
  Non-zero entries: 1,100
  Propagated pairs: 12,345
  Positive-leaning (p_tilde > 0.5): 3,210
  Mean lambda: 0.4123
  Iteration 1 done (3.2s)
--- Gibbs Iteration 2/3 ---
  Sampled theta: 1,250/5,000 binders (25.00%)
  max|delta gamma| = 0.001000, mean|delta| = 0.000100
  Iteration 2 done (0.4s)
--- Gibbs Iteration 3/3 ---
  Sampled theta: 1,251/5,000 binders (25.02%)
  done
"""

SF = "/root/testdata/sf0.001"


def test_files_to_files(spark, tmp_path):
    words = fixtures.labelled_peptides(spark, SF)
    words.write.parquet(str(tmp_path / "obs.parquet"))
    fasta = tmp_path / "in.fasta"
    fasta.write_text("".join(f">{r[0]}\n{r[0]}\n" for r in words.select("long_mer").distinct().orderBy("long_mer").collect()))
    out = str(tmp_path / "out")
    done = pipeline.cluster_file(spark, str(fasta), out, threshold=0.6, least=50)
    assert done["n_short"] == 0 and done["largest"] > 1
    result = pipeline.run(spark, str(tmp_path / "obs.parquet"), f"{out}/clusters.tsv", out, EngineConfig(min_shared=3))
    assert result.pairs.agg(F.sum("n_total")).first()[0] == words.count()
    assert spark.read.parquet(f"{out}/stage1/level1/level1_results.parquet").count() == result.pairs.count()
    level2 = f"{out}/stage1/level2"
    names = [r.hla_name for r in result.index.orderBy("hla_idx").collect()]
    for name in ("S", "OR", "pvalue", "pvalue_adj"):
        dense = np.load(f"{level2}/{name}_matrix.npy")
        wide = spark.read.option("header", True).option("inferSchema", True).csv(f"{level2}/{name}_matrix_wide.csv").toPandas().set_index("row_name").loc[names, names]
        assert dense.shape == (len(names),) * 2 and np.allclose(dense, wide.astype(float).to_numpy(), equal_nan=True) and np.allclose(dense, dense.T, equal_nan=True)
        assert (np.diag(dense) == 0).all() if name == "S" else np.isnan(np.diag(dense)).all()
    stats = spark.read.option("header", True).csv(f"{out}/stage1/diagnostics/run_statistics.csv").collect()
    assert {r.value for r in stats} == {"p_h", "tau_h", "gamma64", "penalty", "p_tilde", "lambda_w"}
    again = pipeline.run(spark, str(tmp_path / "obs.parquet"), f"{out}/clusters.tsv", out, EngineConfig(max_iter=2, sample_theta=False, min_shared=3), propagate_labels=False)
    assert again.labels is None and 1 <= len(again.metrics) <= 2
    (tmp_path / "log.txt").write_text(LOG)
    command.main(["log", str(tmp_path / "log.txt"), str(tmp_path / "log_out")])
    assert spark.read.option("header", True).csv(str(tmp_path / "log_out")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = fixtures.planted(spark, SF)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    incoming = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.maintain(incoming, str(tmp_path / "counts"), str(tmp_path / "check")).awaitTermination()
    got = stream.snapshot(spark.read.parquet(str(tmp_path / "counts"))).select("cluster_id", "allele", "n_pos", "n_neg", "n_total")
    want = stream.snapshot(stream.batch_counts(rows)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
