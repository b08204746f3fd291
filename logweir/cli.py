"""Command line: `python -m logweir FILE --format summary|json|dashboard`."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession

from logweir.config import PROFILES, Config
from logweir.plans import reports, views
from logweir.plans.engine import analyze


def _share(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("must lie between 0 and 1")
    return value


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logweir", description="Analyze a log.")
    p.add_argument("file", help="a file, directory, glob or any path that Spark reads")
    p.add_argument("--format", choices=("summary", "json", "dashboard"), default="summary")
    p.add_argument("--quarantine-threshold", type=_share, default=0.3)
    p.add_argument("--log-timezone", default="local")
    p.add_argument("--naive-timestamps", choices=("local", "utc"), default="local")
    p.add_argument("--reference-date", help="a date; its year is that of times without one")
    p.add_argument("--encoding", default="utf-8")
    p.add_argument("--allow-synthetic-timestamps", action="store_true")
    p.add_argument("--profile", choices=PROFILES, default="pragmatic")
    p.add_argument("--quarantine-out", help="a folder that gets the quarantined records with reason and context, as Parquet")
    return p


def config_of(args: argparse.Namespace) -> Config:
    return Config(threshold=args.quarantine_threshold, log_tz=args.log_timezone, naive_policy=args.naive_timestamps, reference_year=int(args.reference_date[:4]) if args.reference_date else None, encoding=args.encoding, profile=args.profile, synthetic_timestamps=args.allow_synthetic_timestamps, run_ts=time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime()))


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """The report that the arguments ask for."""
    config, began = config_of(args), time.time()
    t = analyze(spark, args.file, config)
    if args.quarantine_out:
        t["quarantined"].write.mode("overwrite").parquet(args.quarantine_out)
    if args.format == "json":
        return reports.document(t, config, seconds=time.time() - began).first()["report"]
    if args.format == "dashboard":
        t["totals"].first()
        return views.panel(t, time.time() - began)
    return reports.summary(t).first()["summary"]


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    if "://" not in args.file and not any(c in args.file for c in "*?[{") and not os.path.exists(args.file):
        print(f"No such file: {args.file}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("logweir").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(views.echo_safe(run(spark, args), sys.stdout.encoding))
    return 0
