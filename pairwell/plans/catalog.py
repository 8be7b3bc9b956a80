"""Queries over the driver's tables, one for each operator family."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import anchors as A
from ..functions import fisher as X
from ..operators import clusters as C
from ..operators import counts as N
from ..operators import diagnostics as D
from ..operators import noise as L
from ..operators import propagate as P
from ..operators import refine as R
from ..operators import reports as O
from ..operators import runlog as G
from ..operators import similarity as S
from ..sources import readers as E
from ..sources import sinks as K
from ..sources.tables import saved, shared_path
from . import fixtures as fx

CFG = EngineConfig(sample_theta=False)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(*names: str) -> list:
    """Columns rounded to six places."""
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


class Plan:
    """The single pass over the planted observations. Steps that others build on are saved, each once and only if needed."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.rows = fx.planted(spark, sf_dir)
        self.sizes = fx.planted_sizes(spark, sf_dir)

    @cached_property
    def sums(self) -> DataFrame:
        return saved(N.pair_sums(self.rows))

    @cached_property
    def index(self) -> DataFrame:
        return N.allele_index(self.sums)

    @property
    def pairs(self) -> DataFrame:
        return N.indexed(self.sums, self.index)

    @property
    def rates(self) -> DataFrame:
        return N.binder_rates(self.pairs, self.index, CFG)

    @cached_property
    def params(self) -> DataFrame:
        return L.noise_params(self.pairs, self.index, CFG).join(self.rates.select("hla_idx", "p_h"), "hla_idx")

    @cached_property
    def called(self) -> DataFrame:
        return saved(L.called(self.pairs, self.params, CFG))

    @cached_property
    def tested(self) -> DataFrame:
        return saved(S.tests(self.called, CFG))

    @cached_property
    def labels(self) -> DataFrame:
        return P.propagated(self.called, S.similarity(self.tested, CFG), self.index, self.sizes, CFG)


# -- observations and counts -----------------------------------------------------------------------
@query
def obs_load(spark, d):
    return N.prepared(fx.labelled_peptides(spark, d), CFG).groupBy("peptide", "allele").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))


@query
def prefix_filter(spark, d):
    return N.prepared(fx.labelled_peptides(spark, d), EngineConfig(allele_prefix="src1")).groupBy("allele").agg(F.count("*").alias("n"))


@query
def label_normalize(spark, d):
    raw = fx.peptides(spark, d).join(fx.table(spark, d, "labels").select("doc_id", F.col("quality").alias("assigned_label")), "doc_id", "left")
    return N.label_distribution(N.prepared(raw, CFG)).select("n_pos", "n_neg", *r6("positive_rate"))


@query
def map_clusters(spark, d):
    mapped = N.mapped(N.prepared(fx.labelled_peptides(spark, d), CFG), N.cluster_map(fx.members(spark, d)))
    index = N.allele_index(N.prepared(fx.labelled_peptides(spark, d), CFG))
    return N.pair_counts(mapped, index)


@query
def unmapped_rate(spark, d):
    return N.unmapped(N.prepared(fx.labelled_peptides(spark, d), CFG), N.cluster_map(fx.members(spark, d))).select("n_obs", "n_unmapped", *r6("pct_unmapped"))


@query
def cluster_sizes(spark, d):
    return N.cluster_sizes(fx.members(spark, d))


@query
def allele_index(spark, d):
    return Plan(spark, d).index


@query
def pair_counts(spark, d):
    return Plan(spark, d).pairs


@query
def count_reconciliation(spark, d):
    p = Plan(spark, d)
    return N.reconciliation(p.rows, p.pairs)


@query
def binder_rates(spark, d):
    return Plan(spark, d).rates.select("hla_idx", "pos", "tot", *r6("p_raw", "p_h"))


# -- noise model -----------------------------------------------------------------------------------
@query
def noise_params(spark, d):
    return L.with_tau(Plan(spark, d).params, CFG).select("hla_idx", *r6("alpha", "beta", "p_h", "tau_h"))


@query
def posterior_gamma(spark, d):
    return Plan(spark, d).called.select("cluster_id", "hla_idx", *r6("gamma64"))


@query
def binarize_calls(spark, d):
    return Plan(spark, d).called.select("cluster_id", "hla_idx", F.col("b_call").cast("int").alias("b_call"))


@query
def gamma_summary(spark, d):
    return O.value_summary(Plan(spark, d).called, "gamma64", 0.5).select("n", *r6("mean", "median", "min", "max"), "n_above")


@query
def phi_pairs(spark, d):
    return Plan(spark, d).pairs.select("cluster_id", "hla_idx", L.phi().alias("phi_ch")).select("cluster_id", "hla_idx", *r6("phi_ch"))


@query
def allele_purity(spark, d):
    p = Plan(spark, d)
    return D.allele_purity(p.pairs, p.index).select("hla_idx", "hla_name", *r6("mean_phi", "std_phi", "median_phi", "min_phi", "max_phi"), "n_clusters")


def _counts(p: Plan) -> DataFrame:
    return D.cluster_counts(p.called, p.index, p.rates).select("hla_idx", "hla_name", "n_binder_clusters", "n_total_clusters", "n_nonbinder_clusters", *r6("p_h", "binder_fraction"))


@query
def cluster_counts(spark, d):
    return _counts(Plan(spark, d))


@query
def top30_alleles(spark, d):
    return D.top_alleles(_counts(Plan(spark, d)))


@query
def phi_histogram(spark, d):
    return D.phi_histogram(Plan(spark, d).pairs).select("bin", *r6("bin_low"), "n")


@query
def fraction_histogram(spark, d):
    p = Plan(spark, d)
    return D.histogram(D.cluster_counts(p.called, p.index, p.rates), F.col("binder_fraction"), 50, 0.0, 1.0).select("bin", *r6("bin_low"), "n")


# -- similarity ------------------------------------------------------------------------------------
@query
def contingency(spark, d):
    return S.contingency(Plan(spark, d).called, CFG.min_shared)


@query
def fisher_pvalues(spark, d):
    return Plan(spark, d).tested.select("h1", "h2", *r6("pvalue"))


@query
def fisher_by_rows(spark, d):
    return X.fisher_by_rows(S.contingency(Plan(spark, d).called, CFG.min_shared), ["h1", "h2"]).select("h1", "h2", *r6("pvalue"))


@query
def odds_ratios(spark, d):
    return Plan(spark, d).tested.select("h1", "h2", *r6("OR", "OR_conservative"), "or_degenerate")


@query
def bh_fdr(spark, d):
    return Plan(spark, d).tested.select("h1", "h2", *r6("pvalue_adj"), "significant")


@query
def similarity(spark, d):
    return S.similarity(Plan(spark, d).tested, CFG).select("h1", "h2", *r6("s"))


@query
def similarity_counts(spark, d):
    return S.similarity_counts(S.similarity(Plan(spark, d).tested, CFG))


@query
def matrix_or_long(spark, d):
    p = Plan(spark, d)
    return S.matrix_long(p.tested, p.index, "OR").select("row_name", "col_name", *r6("value"))


@query
def matrix_or_wide(spark, d):
    p = Plan(spark, d)
    matrix = S.matrix_wide(p.tested, p.index, "OR", [r[0] for r in p.index.orderBy("hla_idx").select("hla_name").collect()])  # a dictionary
    lacking = [n for n in fx.NATIONS if n not in matrix.columns]  # on small tables
    return matrix.withColumns({n: F.lit(None).cast("double") for n in lacking}).select("row_name", *r6(*fx.NATIONS))


@query
def matrix_wide_file(spark, d):
    """The wide file, read back and put into rows again."""
    p, path = Plan(spark, d), shared_path(spark) + ".csv"
    names = [r.hla_name for r in p.index.orderBy("hla_idx").collect()]  # a dictionary
    K.write_wide(S.matrix_long(p.tested, p.index, "OR"), names, path)
    read = spark.read.option("header", True).schema(", ".join(f"`{n}` {'string' if n == 'row_name' else 'double'}" for n in ["row_name", *names])).csv(path)
    return read.unpivot("row_name", names, "col_name", "value").select("row_name", "col_name", *r6("value"))


@query
def heat_cells(spark, d):
    p = Plan(spark, d)
    return D.heat_cells(S.matrix_long(p.tested, p.index, "OR"), "or").select("row_name", "col_name", *r6("shade"))


@query
def associations(spark, d):
    p = Plan(spark, d)
    return S.associations(p.tested, p.index)


@query
def association_histogram(spark, d):
    p = Plan(spark, d)
    return D.association_histogram(S.associations(p.tested, p.index)).select("bin", *r6("bin_low"), "n")


@query
def colour_scale(spark, d):
    return S.colour_scale(Plan(spark, d).tested).select(*r6("p95_abs_log10_or"))


# -- propagation -----------------------------------------------------------------------------------
@query
def rare_targets(spark, d):
    p = Plan(spark, d)
    return P.targets(p.pairs, p.index, CFG)


@query
def coverage_penalty(spark, d):
    p = Plan(spark, d)
    return P.coverage(p.pairs, p.sizes, CFG).select("cluster_id", "n_labelled", "n_members", *r6("penalty"))


@query
def propagate_labels(spark, d):
    return Plan(spark, d).labels.select("cluster_id", "hla_idx", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("p_tilde", "n_tilde", "lambda_w")])


@query
def propagation_summary(spark, d):
    p = Plan(spark, d)
    return P.propagation_summary(p.labels, p.index).select("hla_idx", "hla_name", "n_propagated", *[F.round(c, 4).alias(c) for c in ("mean_p_tilde", "mean_lambda")], "n_positive")


@query
def feedback_rates(spark, d):
    p = Plan(spark, d)
    return P.feedback(p.labels, p.rates.select("hla_idx", "p_h"), CFG).select("hla_idx", *r6("p_h"))


# -- refinement ------------------------------------------------------------------------------------
def _refined(spark, d, n, method):
    p = Plan(spark, d)
    pairs = p.called
    for i in range(1, n + 1):
        pairs = R.step(pairs, p.index, None, CFG, i, method)[0]
        pairs = saved(pairs) if i < n else pairs
    return pairs.select("cluster_id", "hla_idx", *r6("gamma64"), F.col("b_call").cast("int").alias("b_call"))


@query
def gibbs_det_1iter(spark, d):
    return _refined(spark, d, 1, "gibbs")


@query
def gibbs_det_2iter(spark, d):
    return _refined(spark, d, 2, "gibbs")


@query
def em_1iter(spark, d):
    return _refined(spark, d, 1, "em")


@query
def gibbs_delta(spark, d):
    p = Plan(spark, d)
    return R.change(R.step(p.called, p.index, None, CFG, 1)[0]).select(*r6("delta_max", "delta_mean"))


@query
def gibbs_converged(spark, d):
    p = Plan(spark, d)
    done = R.refine(p.called, p.index, p.sizes, EngineConfig(sample_theta=False, max_iter=6))
    return done.pairs.select("cluster_id", "hla_idx", *r6("gamma64"))


@query
def gibbs_sampled(spark, d):
    p = Plan(spark, d)
    return R.step(p.called, p.index, None, EngineConfig(seed=7), 1)[0].select("cluster_id", "hla_idx", *r6("gamma64"))


# -- reports ---------------------------------------------------------------------------------------
@query
def observed_summary(spark, d):
    p = Plan(spark, d)
    return O.observed_summary(p.called, p.index).select("hla_idx", "hla_name", *r6("gamma_mean", "gamma_std", "gamma_median", "gamma_min", "gamma_max"), "gamma_count", "total_pos", "total_neg", "total_obs", "n_clusters")


@query
def observed_with_params(spark, d):
    p = Plan(spark, d)
    noise = L.with_tau(p.params, CFG).select("hla_idx", "alpha", "beta", "p_h", "tau_h")
    return O.observed_summary(p.called, p.index).join(noise, "hla_idx", "left").select("hla_idx", "total_obs", *r6("alpha", "beta", "p_h", "tau_h"))


@query
def propagated_summary(spark, d):
    p = Plan(spark, d)
    names = [f"{n}_{s}" for n in ("ptilde", "ntilde", "lambda") for s in ("mean", "std", "median")]
    return O.propagated_summary(p.labels, p.index).select("hla_idx", "hla_name", "n_propagated", *[F.round(n, 4).alias(n) for n in names], "n_positive")


@query
def run_metrics(spark, d):
    p = Plan(spark, d)
    return O.run_summary(p.called, p.tested, p.labels, p.index)


@query
def gamma_boxes(spark, d):
    return D.boxes(Plan(spark, d).called.withColumn("g", F.round("gamma64", 6)), "hla_idx", "g").select("hla_idx", "n", *r6("q1", "median", "q3", "low", "high"))


@query
def sampled_pairs(spark, d):
    return D.sampled(Plan(spark, d).pairs, "hla_idx", ["cluster_id", "hla_idx"], 300).select("cluster_id", "hla_idx", "n_pos", "n_neg", "n_total")


@query
def jittered_points(spark, d):
    """At most 300 posteriors of each allele, spread sideways."""
    return D.jittered(Plan(spark, d).called, "hla_idx", ["cluster_id", "hla_idx"], "gamma64").select("hla_idx", "cluster_id", *r6("x", "y"))


@query
def sign_bars(spark, d):
    p = Plan(spark, d)
    return D.sign_bars(O.observed_summary(p.called, p.index)).select("hla_idx", "hla_name", *r6("up", "down"))


def _run_log(spark, d) -> str:
    """The log of a refinement of two iterations."""
    p, cfg = Plan(spark, d), EngineConfig(sample_theta=False, max_iter=2, tol=0.0)
    done = R.refine(p.called, p.index, p.sizes, cfg, detailed=True)
    return G.rendered(done.metrics, cfg, datetime.now(), p.index.count())


@query
def gibbs_log_table(spark, d):
    return O.log_table(spark.createDataFrame([(_run_log(spark, d),)], "value string")).drop("iteration_time")


# -- anchors and clusters --------------------------------------------------------------------------
@query
def anchor_extract(spark, d):
    return fx.exact_records(spark, d).select("sequence", A.anchor(F.col("sequence")).alias("anchor"))


@query
def anchor_mask(spark, d):
    return fx.exact_records(spark, d).select("sequence", A.mask(F.col("sequence")).alias("masked"))


@query
def anchor_counts(spark, d):
    return fx.anchors(spark, d).select("anchor", "n")


@query
def anchor_block_sizes(spark, d):
    return C.block_sizes(fx.anchors(spark, d))


@query
def anchor_pair_scores(spark, d):
    a = fx.anchors(spark, d)
    return C.similar_pairs(a, 0.8).select("earlier", "later", F.round(A.score(F.col("earlier"), F.col("later")), 6).alias("score"))


@query
def anchor_comparisons(spark, d):
    """Pairs of anchors in blocks, those that the index makes, the like ones, and centroids."""
    return C.comparisons(fx.anchors(spark, d), 0.8).drop("n_scored")


@query
def exact_clusters(spark, d):
    return C.exact_clusters(fx.exact_records(spark, d))


@query
def greedy_clusters(spark, d):
    return C.greedy_clusters(fx.anchors(spark, d), 0.8)


@query
def cluster_rank(spark, d):
    return C.numbered(C.exact_clusters(fx.exact_records(spark, d)).groupBy("rep").agg(F.count("*").alias("size")), [F.desc("size"), F.asc("rep")], "cluster_num")


@query
def cluster_size_buckets(spark, d):
    return O.size_buckets(C.exact_clusters(fx.exact_records(spark, d)).groupBy("rep").agg(F.count("*").alias("size")))


@query
def cluster_report(spark, d):
    return O.cluster_report(C.exact_clusters(fx.exact_records(spark, d))).select("n_members", "n_clusters", "n_singletons", *r6("pct_singletons"), "max_size", *r6("mean_size", "median_size"))


@query
def extreme_clusters(spark, d):
    records = saved(fx.exact_records(spark, d))  # words are cut from the texts once
    return O.extreme_clusters(C.exact_clusters(records), records.withColumn("ord", F.col("header")))


# -- matrices, plot data and statistics ------------------------------------------------------------
@query
def matrix_similarity(spark, d):
    p = Plan(spark, d)
    return S.similarity_long(S.similarity(p.tested, CFG), p.index).select("row_name", "col_name", *r6("value"))


def _heat(spark, d, column):
    p = Plan(spark, d)
    return D.heat_cells(S.matrix_long(p.tested, p.index, column), "p").select("row_name", "col_name", (F.round("shade", 4) + 0.0).alias("shade"))


@query
def heat_cells_p(spark, d):
    return _heat(spark, d, "pvalue")


@query
def heat_cells_p_adj(spark, d):
    return _heat(spark, d, "pvalue_adj")


@query
def tested_histogram(spark, d):
    p = Plan(spark, d)
    return D.association_histogram(S.associations(p.tested, p.index), "n_tested").select("bin", *r6("bin_low"), "n")


@query
def mean_phi_histogram(spark, d):
    p = Plan(spark, d)
    return D.spread_histogram(D.allele_purity(p.pairs, p.index), F.round("mean_phi", 6), 60).select("bin", F.round("bin_low", 4).alias("bin_low"), "n")


def _label_boxes(spark, d, column):
    rounded = Plan(spark, d).labels.withColumn("g", F.round(F.col(column).cast("double"), 4))
    return D.boxes(rounded, "hla_idx", "g").select("hla_idx", "n", *r6("q1", "median", "q3"), "low", "high")


@query
def p_tilde_boxes(spark, d):
    return _label_boxes(spark, d, "p_tilde")


@query
def n_tilde_boxes(spark, d):
    return _label_boxes(spark, d, "n_tilde")


@query
def lambda_boxes(spark, d):
    return _label_boxes(spark, d, "lambda_w")


@query
def run_statistics(spark, d):
    p = Plan(spark, d)
    found = O.run_statistics(L.with_tau(p.params, CFG), p.called, P.coverage(p.pairs, p.sizes, CFG), p.labels)
    return found.select("stage", "value", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "min", "max")], "n_above")


@query
def summary_by_clusters(spark, d):
    p = Plan(spark, d)
    path = shared_path(spark) + ".csv"
    K.write_csv(O.observed_summary(p.called, p.index).select("hla_idx", "n_clusters"), path, [F.desc("n_clusters"), "hla_idx"])
    read = E.read_table(spark, path, "hla_idx int, n_clusters long")  # one file, whose order is asked for
    return read.select((F.monotonically_increasing_id() + 1).alias("place"), "hla_idx", "n_clusters")


@query
def ordered_labels(spark, d):
    path = shared_path(spark)
    K.write_ordered(Plan(spark, d).labels, path, ["hla_idx", "cluster_id"])
    here = F.struct("hla_idx", "cluster_id")
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(here).alias("low"), F.max(here).alias("high"), F.count("*").alias("n"))
    after = F.lag("high").over(Window.orderBy("file"))  # a row a file
    return files.withColumn("ok", F.coalesce(F.col("low") > after, F.lit(True))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("in_order"))


# -- files -----------------------------------------------------------------------------------------
def _written(spark, d, suffix, sep):
    path = shared_path(spark) + suffix
    fx.labelled_peptides(spark, d).write.option("header", True).option("sep", sep).csv(path)
    return N.prepared(E.read_observations(spark, path, CFG), CFG).groupBy("allele").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos"))


@query
def csv_file(spark, d):
    return _written(spark, d, ".csv", ",")


@query
def tsv_file(spark, d):
    return _written(spark, d, ".tsv", "\t")


def _fasta(spark, d, one_line):
    path, lines = shared_path(spark), [F.concat(F.lit(">"), "header", F.lit(" of words")), F.left("sequence", F.lit(3)), F.substr("sequence", F.lit(4))]
    fx.exact_records(spark, d).select(F.concat_ws("\n", *lines).alias("value")).write.text(path)
    return E.read_fasta(spark, path, one_line).select("header", "sequence")


@query
def fasta_file(spark, d):
    return _fasta(spark, d, False)


@query
def fasta_first_line(spark, d):
    return _fasta(spark, d, True)


@query
def cluster_file(spark, d):
    path = shared_path(spark)
    columns = [F.lit("x").alias(c) for c in ("representative_anchor", "peptide_header")]
    K.write_tsv(fx.members(spark, d).select("cluster_id", *columns, "sequence", F.lit("x").alias("anchor")), path)
    return E.read_clusters(spark, path).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query
def edge_file(spark, d):
    path = shared_path(spark)
    C.exact_clusters(fx.exact_records(spark, d)).write.option("sep", "\t").csv(path)
    return E.read_edges(spark, path).groupBy("rep").agg(F.count("*").alias("n"))


@query
def result_fallback(spark, d):
    path = shared_path(spark)
    K.write_csv(Plan(spark, d).index, path + ".csv", ["hla_idx"])
    return E.read_result(spark, path + ".parquet")


@query
def best_run(spark, d):
    path, p = shared_path(spark), Plan(spark, d)
    for name, rows in (("", p.pairs.limit(1)), ("_gibbs_final", p.called)):  # the refined one is taken
        K.write_parquet(rows, f"{path}/level1_results{name}.parquet")
        K.write_csv(p.params, f"{path}/noise_params{name}.csv", ["hla_idx"])
    return E.best_level1(spark, path)[0].select("cluster_id", "hla_idx", "n_total")


@query
def fasta_sink(spark, d):
    path = shared_path(spark)
    K.write_fasta(fx.members(spark, d).select("cluster_id", F.col("sequence").alias("header"), "sequence"), path, 100)
    return spark.read.text(path).where(F.col("value").startswith(">")).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query
def log_file(spark, d):
    path = shared_path(spark)
    K.write_log(spark, _run_log(spark, d), path)
    return O.log_table(E.read_logs(spark, path)).drop("iteration_time")
