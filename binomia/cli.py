"""Command line: ``python -m binomia.cli map …`` and ``python -m binomia.cli compile …``."""

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession

from .functions.vocab import DEFAULT_CLADES
from .plans.runs import compile_dump, map_file


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="binomia")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("map", help="map the names of a CSV file")
    run.add_argument("--input", "-i", required=True)
    run.add_argument("--output", "-o", default="./output")
    run.add_argument("--name", "-n", default="")
    run.add_argument("--models", required=True, help="CSV with a Filename column")
    run.add_argument("--lookup", required=True, help="stored lookup or its JSON form")
    run.add_argument("--report", action="store_true")
    run.add_argument("--plots", action="store_true")
    build = commands.add_parser("compile", help="compile a taxonomy dump into a lookup")
    build.add_argument("--taxdump", required=True, help="folder of .dmp files or .tar.gz")
    build.add_argument("--output", required=True)
    build.add_argument("--clades", default=",".join(DEFAULT_CLADES))
    build.add_argument("--work-dir")
    build.add_argument("--json", action="store_true")
    return top


def main(arguments=None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("binomia").getOrCreate()
    try:
        if args.command == "map":
            print(
                map_file(
                    spark, args.input, args.models, args.lookup, args.output, args.name,
                    args.report, args.plots,
                )
            )
        else:
            roots = [c.strip() for c in args.clades.split(",") if c.strip()]
            print(json.dumps(compile_dump(
                spark, args.taxdump, args.output, roots, args.work_dir, args.json
            ), indent=2))
    except FileNotFoundError as missing:
        logging.error("not found: %s", missing)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
