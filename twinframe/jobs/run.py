"""spark-submit entry: run the validations of a YAML file. Exit code 1 when any check failed."""

from __future__ import annotations

import argparse
import sys

from twinframe.plans.metadata import metadata_compare
from twinframe.plans.suite import run_suite
from twinframe.session import build_session
from twinframe.sources.sinks import write_results
from twinframe.spec import SuiteSpec, positive_int


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Validate sources against targets")
    parser.add_argument("--config", "-c", required=True, help="YAML file with a list of validations")
    parser.add_argument("--name", "-n", help="run only the validation of this name")
    parser.add_argument("--output", "-o", help="folder for results; overrides the configuration")
    parser.add_argument("--format", default="csv", choices=["csv", "parquet"], help="format of the results")
    parser.add_argument("--target-limit", help="read at most this many rows of table targets")
    parser.add_argument("--quick-sample-pks", help="compare this many sampled source keys only")
    parser.add_argument("--metadata-only", action="store_true", help="compare row and column counts only")
    parsed = parser.parse_args(argv)
    for option in ("target_limit", "quick_sample_pks"):
        setattr(parsed, option, positive_int(getattr(parsed, option), f"--{option.replace('_', '-')}"))
    return parsed


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    suite = SuiteSpec.from_yaml(
        args.config,
        name=args.name,
        target_limit=args.target_limit,
        quick_sample_pks=args.quick_sample_pks,
        output_dir=args.output,
    )
    spark = build_session()
    if args.metadata_only:
        verdicts = metadata_compare(spark, suite.validations)
        path = write_results(verdicts, suite.validations[0].output_dir, "metadata_validation", args.format)
        print(path)
        written = spark.read.option("header", True).format(args.format).load(path)
        return 0 if written.where("status = 'FAILED'").isEmpty() else 1
    result = run_suite(spark, suite)
    for path in result.write(args.format):
        print(path)
    result.summary().show(truncate=False)
    failed = result.failed()
    result.close()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
