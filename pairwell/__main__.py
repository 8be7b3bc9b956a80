"""Commands: cluster, run, report, log."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .config import EngineConfig


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="pairwell")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("cluster", help="cluster the sequences of a FASTA file by their anchors")
    c.add_argument("fasta")
    c.add_argument("out")
    c.add_argument("--threshold", type=float, default=0.6)
    c.add_argument("--min-cluster-size", type=int, default=1)
    r = commands.add_parser("run", help="denoise, compare and propagate labels")
    r.add_argument("observations")
    r.add_argument("clusters")
    r.add_argument("out")
    for flag, kind in (("peptide-col", str), ("allele-col", str), ("label-col", str), ("allele-prefix", str), ("shrinkage-k", float), ("rate-ceil", float), ("tau-max", float), ("fdr", float), ("min-shared", int), ("rare-max-pairs", int), ("max-iter", int), ("tol", float), ("recompute-every", int), ("seed", int)):
        r.add_argument(f"--{flag}", type=kind)
    r.add_argument("--no-allele-filter", action="store_true")
    r.add_argument("--skip-propagation", action="store_true")
    r.add_argument("--deterministic", action="store_true", help="hard states at one half instead of draws")
    r.add_argument("--method", choices=["gibbs", "em"], default="gibbs")
    e = commands.add_parser("report", help="sizes of clusters given as representative and member")
    e.add_argument("edges")
    e.add_argument("--fasta", help="sequences of the largest and smallest clusters' representatives")
    g = commands.add_parser("log", help="table of an iteration log")
    g.add_argument("log")
    g.add_argument("out")
    args = top.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("pairwell").getOrCreate()
    from .operators import reports
    from .plans import pipeline
    from .sources import readers, sinks

    if args.command == "cluster":
        pipeline.cluster_file(spark, args.fasta, args.out, threshold=args.threshold, least=args.min_cluster_size)
    elif args.command == "run":
        given = {k: v for k, v in vars(args).items() if k in EngineConfig.__dataclass_fields__ and v is not None}
        if args.no_allele_filter:
            given.pop("allele_prefix", None)
        cfg = EngineConfig(**given, sample_theta=not args.deterministic)
        pipeline.run(spark, args.observations, args.clusters, args.out, cfg, propagate_labels=not args.skip_propagation, method=args.method)
    elif args.command == "report":
        edges = readers.read_edges(spark, args.edges)
        reports.cluster_report(edges).show(truncate=False)
        sequences = readers.read_fasta(spark, args.fasta, one_line=True) if args.fasta else spark.createDataFrame([], "ord int, header string, sequence string")
        reports.extreme_clusters(edges, sequences).show(truncate=False)
    else:
        sinks.write_log_table(reports.log_table(readers.read_logs(spark, args.log)), args.out)


if __name__ == "__main__":
    main()
