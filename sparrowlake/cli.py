"""Command line: python -m sparrowlake.cli -w WAREHOUSE -e SQL."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from sparrowlake.config import ConfigError
from sparrowlake.session import Engine, EngineError, SessionOptions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparrowlake", description="SQL over snapshot tables")
    p.add_argument("-c", "--config", help="configuration file")
    p.add_argument("-w", "--warehouse", help="warehouse folder, instead of a configuration")
    p.add_argument("--catalog", help="default catalog")
    p.add_argument("--schema", help="default namespace")
    p.add_argument("-e", "--execute", metavar="SQL", help="statement to run")
    p.add_argument("--explain", action="store_true", help="show the plan")
    p.add_argument("--explain-analyze", action="store_true", help="run and show the plan with metrics")
    p.add_argument("--target-partitions", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.execute:
        print('nothing to run; give a statement with -e, as in -e "SHOW TABLES"')
        return 0
    spark = spark or SparkSession.builder.appName("sparrowlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    options = SessionOptions(target_partitions=args.target_partitions)
    try:
        engine = Engine.from_warehouse(spark, args.warehouse, args.schema or "public", options=options) if args.warehouse else Engine.from_config(spark, args.config, options)
        if args.catalog:
            engine.set_default_catalog(args.catalog, args.schema)
        elif args.schema:
            engine.default_schema = args.schema
        if args.explain_analyze:
            print(engine.explain_analyze(args.execute))
        elif args.explain:
            print(engine.explain(args.execute))
        else:
            result = engine.query(args.execute)
            print(result.text())
            print(f"{result.row_count} rows in {result.elapsed_ms:.0f} ms")
    except (ConfigError, EngineError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
