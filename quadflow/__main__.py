"""Run one registered query as a Spark job and write its result.

    spark-submit -m quadflow QUERY SOURCE_DIR OUTPUT_PATH [--format parquet] [--mode overwrite]
    python -m quadflow --list
    python -m quadflow --explain QUERY SOURCE_DIR      (formatted physical plan, nothing written)

The session comes from the cluster (``spark-submit`` settings win); the
result is written by the executors, never collected to the driver.
"""

from __future__ import annotations

import argparse

from quadflow.plans.catalog import queries
from quadflow.session import get_session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quadflow")
    parser.add_argument("query", nargs="?")
    parser.add_argument("source")
    parser.add_argument("output")
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--mode", default="overwrite")
    parser.add_argument("--list", action="store_true")
    if argv is None:
        import sys
        argv = sys.argv[1:]
    if "--list" in argv:
        print("\n".join(sorted(queries())))
        return
    if "--explain" in argv:
        rest = [a for a in argv if a != "--explain"]
        spark = get_session(app_name="quadflow-explain")
        queries()[rest[0]](spark, rest[1]).explain("formatted")
        return
    args = parser.parse_args(argv)
    spark = get_session(app_name=f"quadflow-{args.query}")
    queries()[args.query](spark, args.source).write.format(args.format).mode(args.mode).save(args.output)


if __name__ == "__main__":
    main()
