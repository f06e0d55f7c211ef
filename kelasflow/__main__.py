"""Command line: list or run registered operators.

    python -m kelasflow list
    python -m kelasflow run q25_assignment_progress --tables /data/lms --out /data/out/q25
    python -m kelasflow run q09_student_search --test-dir /root/testdata/sf0.01 --show 20
    python -m kelasflow materialize --test-dir /root/testdata/sf0.1 --tables /data/lms

``--tables`` reads the learning schema at rest (as written by
``materialize`` / ``write_tables``); ``--test-dir`` derives it from the
supplied test tables.  Output goes to parquet (``--out``) or is shown.
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="kelasflow")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name")
    mat = sub.add_parser("materialize")
    for p in (run, mat):
        p.add_argument("--tables")
        p.add_argument("--test-dir")
        p.add_argument("--master")
    run.add_argument("--out")
    run.add_argument("--show", type=int, default=20)
    args = ap.parse_args(argv)

    from kelasflow.plans.registry import load_all
    reg = load_all()
    if args.cmd == "list":
        for name in sorted(reg):
            print(name, "" if reg[name].sql else "(no oracle)")
        return 0

    from kelasflow.session import build_session
    from kelasflow.sources.catalog import read_tables, write_tables
    from kelasflow.sources.fixtures import fixture_tables
    spark = build_session(args.master)
    if args.cmd == "materialize":
        if not (args.test_dir and args.tables):
            ap.error("materialize needs --test-dir and --tables")
        write_tables(fixture_tables(spark, args.test_dir), args.tables)
        return 0
    if args.name not in reg:
        ap.error(f"unknown query {args.name!r}; see `python -m kelasflow list`")
    if args.tables:
        t = read_tables(spark, args.tables)
    elif args.test_dir:
        t = fixture_tables(spark, args.test_dir)
    else:
        ap.error("give --tables or --test-dir")
    df = reg[args.name].job(t)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.show, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
