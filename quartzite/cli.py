"""Command line: clean, profile, trust, stream."""

from __future__ import annotations

import argparse
import json
import sys


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quartzite")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("clean", "profile", "trust", "stream"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--format")
        if name in ("clean", "stream"):
            s.add_argument("--output", required=True)
            s.add_argument("--strategy", default="balanced")
        if name == "trust":
            s.add_argument("--threshold", type=float, default=80.0)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = build_parser().parse_args(argv)
    from quartzite.operators import quality
    from quartzite.plans.cleaning import clean
    from quartzite.sources import tables

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    if args.command == "stream":
        from quartzite.plans.config import CleanOptions
        from quartzite.streaming.cleaner import StreamCleaner

        kind = tables.format_of(args.path, args.format)
        schema = tables.read(spark, args.path, kind).schema
        cleaner = StreamCleaner(CleanOptions(strategy=args.strategy, drop_duplicates=False, fix_dtypes=False))
        sink = cleaner.as_sink(lambda df, i: df.write.mode("overwrite").parquet(f"{args.output}/batch={i}"))
        query = tables.stream_files(spark, args.path, schema, kind).writeStream.foreachBatch(sink).option("checkpointLocation", f"{args.output}/_checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        print(json.dumps(cleaner.finalize(), default=str))
        return 0
    df = tables.read(spark, args.path, args.format)
    if args.command == "clean":
        out, report = clean(df, strategy=args.strategy)
        tables.write(out, args.output)
        print(report.to_json())
    elif args.command == "profile":
        for r in quality.profile(df).collect():
            print(json.dumps(r.asDict(), default=str))
    else:
        got = quality.trust_gate(df, args.threshold, "fail")
        print(json.dumps(got))
        return 0 if got["passed"] else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
