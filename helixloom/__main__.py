"""``python -m helixloom``: assembles the alignments and splice graphs of two files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from helixloom import sinks
from helixloom.operators import dedup, lengths
from helixloom.options import Options
from helixloom.plans.assembly import assemble
from helixloom.sources import alignments, bam, instances
from helixloom.sources.lengths import read_lengths


def parser() -> argparse.ArgumentParser:
    """Names and defaults of the arguments; those of a run without any are the defaults of Options."""
    plain = Options()
    out = argparse.ArgumentParser(prog="helixloom", description="Bayesian transcript assembly on Spark")
    need = out.add_argument_group("required")
    need.add_argument("-b", "--bam-file", required=True, help="alignments: a BAM file or folder, SAM text (.sam), or Parquet (.parquet)")
    need.add_argument("-i", "--instances", required=True, help="splice graphs as instance text")
    need.add_argument("-o", "--output-prefix", required=True, help="folder of the results")
    some = out.add_argument_group("optional")
    some.add_argument("-s", "--strand-specific", choices=("unstranded", "first", "second"), default=plain.strand)
    some.add_argument("-c", "--confidence-threshold", type=float, default=plain.confidence_threshold)
    some.add_argument("-f", "--count-threshold", type=float, default=plain.count_threshold)
    some.add_argument("-m", "--no-pre-mRNA", action="store_true", help="no pre-mRNA among the candidates")
    more = out.add_argument_group("advanced")
    more.add_argument("--seed", type=int, default=plain.seed)
    more.add_argument("--output-mode", choices=("assembly", "full"), default=plain.output_mode)
    more.add_argument("--library-size", type=int, default=plain.library_size, help="read pairs that were sequenced; 0: those that are mapped")
    more.add_argument("--keep-temp-files", action="store_true", help="write the deduplicated alignments as BAM")
    more.add_argument("--max-candidate-number", type=int, default=plain.max_candidates)
    more.add_argument("--dirichlet-parameter", type=float, default=plain.gamma)
    more.add_argument("--frag-mean", type=float)
    more.add_argument("--frag-sd", type=float)
    more.add_argument("--fragment-lengths", help="a file of lengths and probabilities in place of a normal distribution")
    more.add_argument("--gibbs-iteration-scaling", type=int, default=plain.iterations_per_candidate)
    return out


def options_of(args: argparse.Namespace) -> Options:
    return Options(
        strand=args.strand_specific, confidence_threshold=args.confidence_threshold, count_threshold=args.count_threshold, pre_mrna=not args.no_pre_mRNA, seed=args.seed, output_mode=args.output_mode, library_size=args.library_size,
        max_candidates=args.max_candidate_number, gamma=args.dirichlet_parameter, frag_mean=args.frag_mean, frag_sd=args.frag_sd, iterations_per_candidate=args.gibbs_iteration_scaling,
    )


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".sam"):
        return alignments.read_sam(spark, path)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    bam.register(spark)
    return spark.read.format("bam").load(path)


def main(arguments: list[str], spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    options = options_of(args)
    spark = spark or SparkSession.builder.appName("helixloom").getOrCreate()
    records = read_alignments(spark, args.bam_file)
    model = lengths.Empirical(read_lengths(spark, args.fragment_lengths)) if args.fragment_lengths else None
    done = assemble(records, *instances.read_instances(spark, args.instances), options, model)
    sinks.write_run(done, args.output_prefix)
    if args.keep_temp_files:
        files = bam.files_of(args.bam_file) if not args.bam_file.endswith((".sam", ".parquet")) else []
        references = bam.header(files[0])[0] if files else [(r["ref"], (1 << 31) - 1) for r in records.filter("ref IS NOT NULL").select("ref").distinct().orderBy("ref").collect()]
        sinks.write_deduplicated(records, dedup.fragments_of(records, options), f"{args.output_prefix}/deduplicated", references)


if __name__ == "__main__":
    main(sys.argv[1:])
