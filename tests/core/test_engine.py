"""The engine's operators: catalogue against SQL, goldens, properties and planted truth."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import queries as jobs
from pairwell.config import EngineConfig
from pairwell.functions import anchors, fisher
from pairwell.operators import clusters, counts, noise, propagate, refine, reports, similarity
from pairwell.plans import catalog, fixtures, oracle
from pairwell.sources import readers, sinks

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
GOLD = {(8, 2, 1, 5): 0.034965034965, (3, 1, 1, 3): 0.485714285714, (10, 0, 0, 10): 1.082508822447e-05, (0, 5, 5, 0): 0.007936507937, (12, 5, 29, 2): 0.080268552074, (0, 0, 3, 4): 1.0}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    value = lambda v: None if v is None else (round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v)
    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_against_sql(spark, duck, name):
    got = (catalog.QUERIES | jobs.QUERIES)[name](spark, SF)
    want = duck.sql(oracle.ORACLE[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    order = [want.columns.index(n) for n in names]
    assert plain(got.select(*[F.col(f"`{n}`") for n in names]).collect()) == plain([[r[k] for k in order] for r in want.fetchall()])


def test_fisher_goldens(spark):
    for table, p in GOLD.items():
        assert fisher.two_sided(*([x] for x in table))[0] == pytest.approx(p, rel=1e-9)
    many = np.array([*GOLD, *GOLD, (300, 20, 40, 900)]).T
    assert fisher.two_sided(*many, most=1) == pytest.approx(fisher.two_sided(*many), rel=1e-12) and len(fisher.two_sided([], [], [], [])) == 0
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate([*GOLD, (300, 20, 40, 900)])], "i int, a long, b long, c long, d long")
    by_rows = {r.i: r.pvalue for r in fisher.fisher_by_rows(rows, ["i"]).collect()}
    by_udf = {r.i: r.p for r in rows.select("i", fisher.fisher("a", "b", "c", "d").alias("p")).collect()}
    assert by_rows == pytest.approx(by_udf, rel=1e-9) and [by_rows[i] for i in range(6)] == pytest.approx(list(GOLD.values()), rel=1e-9)
    assert 0 < fisher.two_sided([500_000], [1000], [1200], [499_000])[0] + 1e-300 <= 1


def test_greedy_equals_rounds(spark):
    a = fixtures.anchors(spark, SF).where(F.col("n") > 2).cache()
    for t in (0.4, 0.6, 0.8):
        one, two = (sorted(map(tuple, f(a, t).select("anchor", "centroid").collect())) for f in (clusters.greedy_clusters, clusters.clusters_by_rounds))
        assert one == two and len(one) == a.count()
    with pytest.raises(ValueError):
        clusters.greedy_clusters(a, 1.5)


def test_greedy_equals_a_plain_loop(spark):
    rows = clusters.prioritised(fixtures.anchors(spark, SF)).where("g2 in (0, 1)").orderBy("g2", "g6", "prio").collect()
    m, at, want, centres = anchors.matrix().tolist(), {c: i for i, c in enumerate(anchors.RESIDUES)}, {}, {}
    for r in rows:
        own = centres.setdefault((r.g2, r.g6), [])
        for c in own:
            score = 0.0
            for k in anchors.ORDER:
                score += anchors.WEIGHTS[k] / 8 * m[at[r.anchor[k]]][at[c[k]]]
            if score >= 0.6:
                want[r.anchor] = c
                break
        else:
            own.append(r.anchor)
            want[r.anchor] = r.anchor
    got = dict(map(tuple, clusters.greedy_clusters(fixtures.anchors(spark, SF), 0.6).select("anchor", "centroid").collect()))
    assert {a: got[a] for a in want} == want
    assert (len(got), len(set(got.values()))) == (13_380, 1_119)


def test_planted_truth(spark):
    p = catalog.Plan(spark, SF)
    tested = p.tested.collect()
    region = {r.n_name: r.n_regionkey for r in fixtures.table(spark, SF, "nation").collect()}
    of = {r.hla_idx: region[r.hla_name] for r in p.index.collect()}
    assert all(r.significant == (of[r.h1] == of[r.h2]) for r in tested) and all(r.a + r.b + r.c + r.d == r.shared and r.pvalue_adj >= r.pvalue for r in tested)
    observed = {(r[0], r[1]) for r in p.pairs.select("cluster_id", "hla_idx").collect()}
    assert not observed & {(r.cluster_id, r.hla_idx) for r in p.labels.collect()}


def test_refinement(spark):
    p = catalog.Plan(spark, SF)
    done = refine.refine(p.called, p.index, p.sizes, EngineConfig(sample_theta=False, max_iter=8))
    assert done.metrics[-1]["delta_max"] < 1e-3 or len(done.metrics) == 8
    assert done.pairs.count() == p.pairs.count() and done.labels.count() and done.params.where("p_h < 0.001 or p_h > 0.95").count() == 0
    soft = refine.refine(p.called, p.index, p.sizes, EngineConfig(max_iter=2), method="em", propagate=False)
    assert soft.labels is None and len(soft.metrics) == 2
    draw = lambda n: sorted(map(tuple, refine.states(p.called.repartition(n), EngineConfig(seed=3), 1).select("cluster_id", "hla_idx", "theta").collect()))
    assert draw(1) == draw(5)


def test_hand_rows(spark):
    cfg = EngineConfig()
    raw = spark.createDataFrame([("ACDEFGHIK", "A1", None), ("ACDEFGHIK", None, 1), ("ACDEF", "A1", 1), ("acdefghik", "A1", 1), ("WWWWWWWWW", "A2", 1), ("ACDEFGHIK", "A1", 1)], "long_mer string, allele string, assigned_label int")
    obs = counts.prepared(raw, cfg)
    assert obs.count() == 5 and tuple(counts.dropped_alleles(raw, cfg).first()) == (6, 1)
    members = spark.createDataFrame([("cluster_7", "ACDEFGHIK"), ("cluster_7", "ACDEFGHIK")], "cluster_id string, sequence string")
    mapping, index = counts.cluster_map(members), counts.allele_index(obs)
    pairs = counts.pair_counts(counts.mapped(obs, mapping), index)
    assert [tuple(r) for r in pairs.collect()] == [(7, 0, 1, 1, 2)]
    assert [tuple(r) for r in counts.cluster_sizes(members).collect()] == [(7, 2)]
    assert counts.unmapped(obs, mapping).first().n_unmapped == 3
    rates = {r.hla_idx: r for r in counts.binder_rates(pairs, index, cfg).collect()}
    assert rates[1].tot == 0 and rates[1].p_h == pytest.approx(0.5)
    both = counts.mapped(counts.prepared(raw, EngineConfig(normalize_case=True)), mapping)
    assert both.count() == 3
    with pytest.raises(Exception, match="labels are"):
        counts.prepared(spark.createDataFrame([("A", "B", 2)], raw.schema), cfg).collect()
    with pytest.raises(Exception, match="two clusters"):
        counts.cluster_map(spark.createDataFrame([("cluster_1", "A"), ("cluster_2", "A")], members.schema)).collect()
    with pytest.raises(ValueError):
        EngineConfig(fdr=2)


def test_empty_pairs_are_typed(spark):
    p = catalog.Plan(spark, SF)
    none = p.called.limit(0)
    tested = similarity.tests(none, EngineConfig())
    assert tested.count() == 0 and {"OR", "pvalue_adj", "significant"} <= set(tested.columns)
    assert propagate.propagated(none, similarity.similarity(tested, EngineConfig()), p.index, p.sizes, EngineConfig()).count() == 0
    assert similarity.colour_scale(tested).first()[0] == 1.0
    assert similarity.associations(tested, p.index).count() == p.index.count()


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partitions_do_not_matter(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(map(tuple, catalog.QUERIES["bh_fdr"](spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    test_partitions_do_not_matter.seen = getattr(test_partitions_do_not_matter, "seen", got)
    assert got == test_partitions_do_not_matter.seen


def test_unknown_residues(spark):
    row = spark.createDataFrame([("AXDEFGHIX", "ACDIKé", "ACDIKL")], "s string, a string, b string").select(anchors.anchor(F.col("s")).alias("x"), *[c.alias(n) for c, n in zip(anchors.block(anchors.anchor(F.col("s"))), ("g2", "g6"), strict=True)], anchors.score(F.col("a"), F.col("b")).alias("v")).first()
    assert (row.x, row.g2, row.g6) == ("AXDHIX", -1, -1) and row.v == pytest.approx(0.75)
    m = anchors.matrix()
    assert np.allclose(m, m.T) and (m - np.eye(20)).max() == pytest.approx(0.75)


def test_files(spark, tmp_path):
    fasta = tmp_path / "x.fasta"
    fasta.write_text("noise\n>p1 some words\nACDEF\nGHIK\n\n>p2\nAAA\n>p3\nacdefghik")
    got = readers.read_fasta(spark, str(fasta)).orderBy("ord").collect()
    assert [(r.header, r.sequence) for r in got] == [("p1", "ACDEFGHIK"), ("p2", "AAA"), ("p3", "acdefghik")]
    assert [r.sequence for r in readers.read_fasta(spark, str(fasta), one_line=True).orderBy("ord").collect()] == ["ACDEF", "AAA", "acdefghik"]
    valid, short = clusters.split_short(readers.read_fasta(spark, str(fasta)))
    mapping = clusters.greedy_clusters(clusters.anchor_counts(valid, F.col("ord")), 0.8)
    members = clusters.memberships(valid, mapping, clusters.ranked_clusters(valid, mapping))
    sinks.write_tsv(members, str(tmp_path / "clusters.tsv"))
    assert sorted(map(tuple, readers.read_clusters(spark, str(tmp_path / "clusters.tsv")).collect())) == [("cluster_0", "ACDEFGHIK")] * 2
    sinks.write_fasta(members.select("cluster_id", F.col("peptide_header").alias("header"), "sequence"), str(tmp_path / "fa"), 2)
    sinks.write_short(short, str(tmp_path / "short"))
    assert ">p2" in spark.read.text(str(tmp_path / "short"), wholetext=True).first()[0]
    obs = spark.createDataFrame([("A", "B", 1, 9), ("C", "D", None, 9)], "long_mer string, allele string, assigned_label int, other int")
    sinks.write_parquet(obs, str(tmp_path / "o.parquet"))
    sinks.write_csv(obs, str(tmp_path / "o.csv"), ["long_mer"])
    sinks.write_tsv(obs, str(tmp_path / "o.TSV"))
    for name in ("o.parquet", "o.csv", "o.TSV"):
        assert sorted(map(tuple, readers.read_observations(spark, str(tmp_path / name), EngineConfig()).collect())) == [("A", "B", 1), ("C", "D", None)]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.orc")
    with pytest.raises(FileNotFoundError):
        readers.required(spark, str(tmp_path / "none"))
    assert readers.read_result(spark, str(tmp_path / "o.csv")).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_result(spark, str(tmp_path / "none.parquet"))
    (tmp_path / "e.tsv").write_text("r\tm\nr\tn\n")
    assert reports.cluster_report(readers.read_edges(spark, str(tmp_path / "e.tsv"))).first().max_size == 2
    (tmp_path / "log.txt").write_text(LOG)
    table = reports.log_table(readers.read_logs(spark, str(tmp_path / "log.txt")))
    assert [r.theta_binders for r in table.orderBy("iteration").collect()] == [1234, 1250, 1251]
    assert sinks.write_log_table(table, str(tmp_path / "log"))["iteration"]


def test_posterior_edges(spark):
    got = spark.range(1).select(noise.posterior(*(F.lit(float(x)) for x in (1000, 0, 0.1, 0.02, 0.5))).alias("a"), noise.posterior(*(F.lit(float(x)) for x in (0, 1000, 0.1, 0.02, 0.5))).alias("b")).first()
    assert got.a == 1 - 1e-10 and got.b == 1e-10


@pytest.mark.parametrize("cells", [1 << 18, 60, 1])
def test_matrix_files(spark, tmp_path, monkeypatch, cells):
    monkeypatch.setattr(sinks, "CELLS", cells)
    p = catalog.Plan(spark, SF)
    names = [r.hla_name for r in p.index.orderBy("hla_idx").collect()]
    long = similarity.matrix_long(p.tested, p.index, "OR")
    want, at = np.full((len(names),) * 2, np.nan), {n: i for i, n in enumerate(names)}
    for r in long.collect():
        want[at[r.row_name], at[r.col_name]] = np.nan if r.value is None else r.value
    for _ in range(2):  # a rerun replaces
        sinks.write_matrix(long, names, str(tmp_path / "m"))
    np.save(tmp_path / "want.npy", want)
    assert (tmp_path / "m.npy").read_bytes() == (tmp_path / "want.npy").read_bytes() and np.isnan(np.diag(want)).all()
    wide = spark.read.option("header", True).csv(str(tmp_path / "m_wide.csv")).collect()
    assert [r.row_name for r in wide] == names and wide[0].asDict().keys() == {"row_name", *names}
    assert np.allclose([[np.nan if r[n] is None else float(r[n]) for n in names] for r in wide], want, equal_nan=True)


def test_matrix_of_nothing_and_of_odd_names(spark, tmp_path):
    empty = spark.createDataFrame([], "row_name string, col_name string, value double")
    sinks.write_npy(empty, [], str(tmp_path / "none.npy"))
    assert np.load(tmp_path / "none.npy").shape == (0, 0)
    names = ['a,b', 'c"d']
    rows = spark.createDataFrame([(x, y, float(i)) for i, (x, y) in enumerate((x, y) for x in names for y in names)], empty.schema)
    sinks.write_wide(rows, names, str(tmp_path / "odd.csv"))
    read = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "odd.csv"))
    assert {r.row_name for r in read.collect()} == {'a,b', 'c"d'} or read.count() == 2
