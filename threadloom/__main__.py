"""Command line: join or cluster the strings of a file."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from threadloom.operators.cluster import cluster
from threadloom.operators.join import edit_join_exact, edit_join_lsh
from threadloom.params import ALPHABETS, JoinParams
from threadloom.sinks.files import Report, write_consensus, write_pairs
from threadloom.sources.strings import read_strings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="threadloom", description=__doc__)
    p.add_argument("-a", "--alg", type=int, default=1, help="1 join (also for any other number), 2 cluster")
    p.add_argument("-r", "--read", required=True, help="text or FASTQ file")
    p.add_argument("-d", "--device", default="", help="accepted and ignored: Spark schedules")
    p.add_argument("-s", "--samplingrange", type=int, required=True)
    p.add_argument("-c", "--countfilter", type=int, required=True)
    p.add_argument("-b", "--batch_size", type=int, default=0, help="accepted and ignored: Spark partitions")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-n", "--dataset_name", default="")
    p.add_argument("-t", "--num_thread_ed_dist", type=int, default=0, help="accepted and ignored")
    p.add_argument("-p", "--min_pts", type=int, default=10)
    for name, default in (("num_str", 7), ("num_hash", 16), ("num_bits", 12), ("k", 150), ("shift", 50), ("chunk_size", 100_000)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--alphabet", type=int, default=4, choices=sorted(ALPHABETS))
    p.add_argument("--exact", action="store_true", help="find all pairs instead of nearly all")
    p.add_argument("-o", "--output", help="folder for pairs or consensus strings, and the timing report")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    names = ("num_str", "num_hash", "num_bits", "alphabet", "k", "shift", "min_pts", "chunk_size")
    params = JoinParams(sampling_range=args.samplingrange, count_filter=args.countfilter, **{n: getattr(args, n) for n in names})
    logging.getLogger("threadloom").info("%s", params)
    spark = SparkSession.builder.appName("threadloom").getOrCreate()
    report = Report()
    with report.step("read"):
        strings = read_strings(spark, args.read)
    if args.alg == 2:
        with report.step("cluster"):
            found = cluster(strings, params, args.exact, params.letters if args.alphabet <= 5 else None)
            if args.output:
                write_consensus(found, f"{args.output}/consensus_results")
            print(f"clusters: {found.count()}")
    else:
        with report.step("join"):
            joined = edit_join_exact(strings, params.k, "i") if args.exact else edit_join_lsh(strings, params, "i")
            pairs = joined.pairs()
            if args.output:
                write_pairs(pairs, strings, f"{args.output}/join_output")
            print(f"candidates verified: {joined.candidates.count()}, pairs: {pairs.count()}")
    if args.output:
        report.write(spark, f"{args.output}/report-{args.dataset_name}")


if __name__ == "__main__":
    main()
