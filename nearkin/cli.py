"""Command line: ``python -m nearkin -m edit-single -in reads.fas -k 10 -l 11``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from nearkin import __version__
from nearkin.plans.join import SimilarityJoin
from nearkin.session import get_spark, peak_memory
from nearkin.sources.fasta import get_sample, is_folder, read_fasta, sample_name_of, write_pairs

# Mode names with metric and input kind, default settings, and the method part of
# output names.
MODES = {
    "edit-single": ("edit", "single"),
    "hamming-single": ("hamming", "single"),
    "edit-multi": ("edit", "multi"),
    "hamming-multi": ("hamming", "multi"),
    "brute-edit-single": ("edit", "brute"),
}
DEFAULTS = {"k": 10, "l": 11, "in": "cleaned_independent_264/AMC_P01_1b.fas", "outDir": "output/"}
METHOD_NAMES = {"edit": "signature", "hamming": "signature-hamming", "brute": "brute"}


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        self.print_help()
        print(f"Error! {message}")
        raise SystemExit(1)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="nearkin", add_help=False, allow_abbrev=False)
    p.add_argument("-m", dest="mode", required=True, choices=MODES, help="method")
    p.add_argument("-in", dest="input", default=DEFAULTS["in"], help="FASTA file or folder")
    p.add_argument("-k", type=int, default=DEFAULTS["k"], help="distance threshold")
    p.add_argument("-l", type=int, default=DEFAULTS["l"], help="l-mer length; for hamming-single the number of chunks")
    p.add_argument("-outDir", dest="out", default=DEFAULTS["outDir"], help="output folder")
    p.add_argument("-threads", default=None, help="local cores; leave out under spark-submit")
    p.add_argument("-strict", action="store_true", help="report nothing when fewer than two chunks must survive")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> SimilarityJoin | None:
    """Run one mode and write its pairs; each output is a folder of text parts."""
    metric, kind = MODES[args.mode]
    print(f"k= {args.k}, l={args.l}")
    if kind == "multi":
        if not is_folder(spark, args.input):
            print("Input is not a directory")
            return None
        reads = read_fasta(spark, args.input, layout="file")
        join = SimilarityJoin(reads, args.k, metric, "across", l=args.l, sample="sample", strict=args.strict)
        name = f"multi-{METHOD_NAMES[metric]}-output.txt"
    else:
        reads = get_sample(spark, args.input)
        if reads is None:
            return None
        keys = {"brute": {}, "single": {"l": args.l} if metric == "edit" else {"chunks": args.l}}[kind]
        join = SimilarityJoin(reads, args.k, metric, strict=args.strict, **keys)
        method = METHOD_NAMES["brute" if kind == "brute" else metric]
        name = f"{sample_name_of(args.input)}-{method}-output.txt"
    start = time.time()
    out = f"{args.out.rstrip('/')}/{name}"
    figures = join.metrics().first().asDict()
    write_pairs(join.edges(), out)
    for figure, value in figures.items():
        print(f"{figure.replace('_', ' ')} = {value}")
    print(f"Output is available at {out}")
    print(f"Peak memory: {peak_memory(spark) >> 20}, MB")
    print(f"Total run time: {round((time.time() - start) * 1000)}, ms")
    return join


def main(argv: list[str] | None = None) -> None:
    print(f"nearkin version: {__version__}")
    argv = sys.argv[1:] if argv is None else argv
    if "-help" in argv:
        parser().print_help()
        raise SystemExit(1)
    args = parser().parse_args(argv)
    spark = get_spark("nearkin", args.threads) if args.threads else get_spark("nearkin")
    try:
        run(spark, args)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
