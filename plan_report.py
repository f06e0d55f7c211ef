"""Physical-plan summary of the headline queries on the parquet layout.

    python plan_report.py [/root/testdata/sf0.1] > PLANS.md

For each query: number of shuffles (hash / range / single-partition),
broadcasts, join strategies, aggregates, any Python evaluation, and the
filters pushed into each parquet scan with its read schema -- the things to
check after every change.  (The plan is AQE's initial plan; codegen stages
and runtime broadcasts are decided when it runs.)
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

sys.path.insert(0, ".")

from bench import headline  # noqa: E402
from kelasflow.session import build_session  # noqa: E402
from kelasflow.sources.catalog import read_tables, write_tables  # noqa: E402
from kelasflow.sources.fixtures import fixture_tables  # noqa: E402
from kelasflow.streaming.streams import scratch  # noqa: E402


def summary(df) -> list[str]:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    # node detail sections: "(N) Name ...\n<attributes>"
    nodes = re.findall(r"^\((\d+)\) ([^\n]+)\n(.*?)(?=^\(\d+\) |\Z)", text, re.S | re.M)
    kinds: dict[str, int] = {}
    shuffles = {"hash": 0, "range": 0, "single": 0, "round-robin": 0}
    scans = []
    for _, head, body in nodes:
        kind = head.split(" [")[0].strip()
        kinds[kind] = kinds.get(kind, 0) + 1
        if kind == "Exchange":
            if "hashpartitioning" in body:
                shuffles["hash"] += 1
            elif "rangepartitioning" in body:
                shuffles["range"] += 1
            elif "SinglePartition" in body:
                shuffles["single"] += 1
            else:
                shuffles["round-robin"] += 1
        if kind.startswith("Scan parquet"):
            loc = re.search(r"Location: [^\[]*\[([^\]]*)\]", body)
            pushed = re.search(r"PushedFilters: (\[.*?\])\n", body)
            schema = re.search(r"ReadSchema: (struct<.*?>)\n", body)
            name = loc.group(1).rstrip("/").split("/")[-1] if loc else "?"
            scans.append(f"scan {name}: pushed={pushed.group(1) if pushed else '[]'} "
                         f"read={schema.group(1) if schema else '?'}")
    joins = {k: v for k, v in kinds.items() if k.endswith("Join")}
    python = any(k in kinds for k in ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas",
                                      "MapInPandas"))
    return [
        "shuffles: " + ", ".join(f"{k}={v}" for k, v in shuffles.items() if v) +
        f"; broadcasts={kinds.get('BroadcastExchange', 0)}",
        "joins: " + (", ".join(f"{k}={v}" for k, v in sorted(joins.items())) or "none"),
        f"aggregates: {sum(v for k, v in kinds.items() if 'Aggregate' in k)}; "
        f"python evaluation: {'yes' if python else 'no'}",
    ] + scans


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=32)
    root = scratch(spark, "plan-report")
    write_tables(fixture_tables(spark, sf_dir), root)
    t = read_tables(spark, root)
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `python plan_report.py {sf_dir}` on the parquet layout written by `write_tables` "
          "(AQE on; the final plan may still change at run time, e.g. more broadcasts).\n")
    for name, build in headline(t).items():
        print(f"## {name}\n")
        print("```")
        for line in summary(build()):
            print(line)
        print("```\n")


if __name__ == "__main__":
    main()
