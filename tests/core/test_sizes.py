"""Steps whose memory or passes must not grow with the tables."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.config import EngineConfig
from pairwell.functions import fisher
from pairwell.operators import noise, propagate, similarity
from pairwell.plans import catalog


def test_fisher_by_rows_of_long_supports(spark):
    tables = [(0, 40_000, 9_000, 8_500, 60_000), (1, 0, 30_000, 30_000, 0), (2, 2, 3, 4, 5), (3, 0, 0, 4, 5), (4, 20_000, 20_000, 20_100, 20_000), (5, 4095, 1, 1, 4096)]
    found = fisher.fisher_by_rows(spark.createDataFrame(tables, "i int, a long, b long, c long, d long"), ["i"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "window" not in plan.lower() and "4096" in plan  # no task holds the support of a table
    want = fisher.two_sided(*np.array([t[1:] for t in tables]).T)
    assert {r.i: r.pvalue for r in found.collect()} == pytest.approx(dict(enumerate(want)), rel=1e-6, abs=1e-300)


def test_exact_tests_in_little_memory():
    tables = np.random.default_rng(0).integers(1, 400_000, (4, 300))
    tracemalloc.start()
    found = fisher.two_sided(*tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6 and found == pytest.approx(fisher.two_sided(*tables, most=1_000_000), rel=1e-9, abs=1e-300)


def test_contingency_blocks_stay_small(spark):
    pairs = spark.range(300_000).select((F.col("id") / 10).cast("long").alias("cluster_id"), (F.col("id") % 10).cast("int").alias("hla_idx"), (F.col("id") % 3 == 0).cast("int").alias("b_call"))
    cells = similarity.contingency(pairs)
    assert "pmod(xxhash64(cluster_id" in (plan := cells._jdf.queryExecution().optimizedPlan().toString()) and ", 42), 3)" in plan  # 131,072 pairs a block, so three
    assert cells.count() == 45 and {r[0] for r in cells.select("shared").distinct().collect()} == {30_000}


def test_extreme_clusters_cut_words_once(spark):
    found = catalog.QUERIES["extreme_clusters"](spark, "/root/testdata/sf0.001")
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()  # the words are saved
    sizes = {r.end: r["max(size)"] for r in found.groupBy("end").max("size").collect()}
    assert found.count() == 10 and sizes["top"] >= sizes["bottom"]


def test_contingency_sorts_by_one_number(spark):
    pairs = spark.range(1000).select((F.col("id") / 10).cast("long").alias("cluster_id"), (F.col("id") % 10).cast("int").alias("hla_idx"), F.lit(1).alias("b_call"))
    plan = similarity.contingency(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow [task" in plan and "lambdafunction" not in plan


def test_logarithms_of_alleles_only(spark):
    pairs = spark.createDataFrame([(1, 0, 3, 1, 4), (2, 0, 0, 9, 9)], "cluster_id long, hla_idx int, n_pos long, n_neg long, n_total long")
    params = spark.createDataFrame([(0, 0.1, 0.02, 0.3)], "hla_idx int, alpha double, beta double, p_h double")
    found = noise.called(pairs, params, EngineConfig())
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "ln(" not in above.lower() and "exp(" in above.lower()
    want = pairs.join(params, "hla_idx").select("cluster_id", noise.posterior(*(F.col(c) for c in ("n_pos", "n_neg", "alpha", "beta", "p_h"))))
    assert sorted(map(tuple, found.select("cluster_id", "gamma64").collect())) == sorted(map(tuple, want.collect()))


def test_nothing_is_read_to_propagate_nothing(spark):
    pairs = spark.range(100).select((F.col("id") / 2).cast("long").alias("cluster_id"), (F.col("id") % 2).cast("int").alias("hla_idx"), F.lit(1).cast("long").alias("n_total"), F.lit(0.5).cast("float").alias("gamma"))
    index, sizes = spark.createDataFrame([(0, "a"), (1, "b")], "hla_idx int, hla_name string"), pairs.groupBy("cluster_id").agg(F.count("*").alias("n_members"))
    s = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0)], "h1 int, h2 int, s double")
    none = propagate.propagated(pairs, s, index, sizes, EngineConfig(rare_max_pairs=1))
    plan = none._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("LocalRelation <empty>") and none.count() == 0
    assert propagate.propagated(pairs.where("hla_idx = 0"), s, index, sizes, EngineConfig()).count() == 50
