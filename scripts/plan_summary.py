"""Summarise the physical plans of the headline queries (PLANS.md).

For each query: number of shuffle exchanges, broadcast exchanges, join
strategies, aggregate / window / sort operators, and the columns each
Parquet scan reads; first for the stage tables the query writes, then for
the query that reads them. Usage: python scripts/plan_summary.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from pairforge.plans.catalog import QUERIES  # noqa: E402
from pairforge.session import get_session  # noqa: E402

OPS = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
       "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
       "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Window", "Sort ", "MapInPandas",
       "ArrowEvalPython"]


def summarise(plan: str) -> dict:
    c = collections.Counter()
    for line in plan.splitlines():
        s = line.strip(" :+-*")
        for op in OPS:
            if s.startswith(op):
                c[op.strip()] += 1
    c["codegen stages"] = len(set(re.findall(r"\*\((\d+)\)", plan)))
    return c


def scans(plan: str) -> list[str]:
    out = []
    for m in re.finditer(r"FileScan parquet [^\[]*\[([^\]]*)\].*?Location: [^\[]*\[([^\]]*)\]", plan):
        cols = ",".join(x.split("#")[0] for x in m.group(1).split(","))
        loc = m.group(2).rstrip("/").split("/")[-1]
        loc = re.sub(r"-[0-9a-f]{12}$", "", loc)  # scratch tables carry a unique suffix
        out.append(f"{loc}: {cols}")
    return sorted(set(out))


def report(title: str, df) -> None:
    plan = df._jdf.queryExecution().executedPlan().toString()
    c = summarise(plan)
    print(f"{title}\n")
    print("| operator | count |\n|---|---|")
    for op in [o.strip() for o in OPS] + ["codegen stages"]:
        if c.get(op):
            print(f"| {op} | {c[op]} |")
    sc = scans(plan)
    if sc:
        print("\nSource scans (columns read):\n")
        for s in sc:
            print(f"- {s}")
    print()


def main():
    import pairforge.session as session
    written, write = [], session.materialize

    def recorded(df, name="table"):
        written.append((name, df))
        return write(df, name)
    session.materialize = recorded  # stages look it up when they write
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    print("# PLANS\n")
    print(f"Executed-plan summaries of the headline queries at `{sf_dir}` (adaptive plans before runtime")
    print("re-optimisation; counts are operator occurrences). Generated by `scripts/plan_summary.py`.")
    print("`Exchange SinglePartition` entries are final merges of one-row global aggregates (scalar")
    print("subqueries such as the first validation step), not windows or joins.\n")
    for name in HEADLINE:
        written.clear()
        df = QUERIES[name](spark, sf_dir)
        print(f"## {name}\n")
        for table, stage in written:
            report(f"### stage table `{table}`", stage)
        report("### query", df)
    spark.stop()


if __name__ == "__main__":
    main()
