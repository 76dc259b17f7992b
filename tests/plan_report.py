"""Write PLANS.md: the physical operators each headline query is planned with.

Usage: python tests/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

KEYS = [("TakeOrderedAndProject", "top-k"), ("WindowGroupLimit", "group limit"), ("BroadcastHashJoin", "broadcast join"),
        ("SortMergeJoin", "sort-merge join"), ("BroadcastNestedLoopJoin", "nested-loop join"),
        ("CartesianProduct", "cartesian"), ("Exchange hashpartitioning", "hash shuffle"),
        ("Exchange rangepartitioning", "range shuffle"), ("Exchange RoundRobinPartitioning", "round-robin shuffle"),
        ("ArrowEvalPython", "Arrow Python UDF"), ("BatchEvalPython", "row Python UDF"), ("MapInPandas", "mapInPandas"),
        ("HashAggregate", "hash agg"), ("ObjectHashAggregate", "object agg"), ("SortAggregate", "sort agg"),
        ("Window", "window"), ("Generate", "explode"), ("Scan ExistingRDD", "checkpoint read")]


def main(argv):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from tidepool.session import build_session
    import __spark_entry__ as E
    import bench
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    qs = E.queries()
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tests/plan_report.py` on `{sf}` (executed plans, AQE final where materialised).",
           "Counts are operator occurrences; pushed filters and partition filters are quoted from the scans.", "",
           "| query | operators | pushed / partition filters |", "|---|---|---|"]
    for name in bench.HEADLINE:
        df = qs[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        ops = []
        for key, label in KEYS:
            n = len(re.findall(re.escape(key) + (r"\b" if key[0].isalpha() else ""), plan))
            if n:
                ops.append(f"{label}×{n}")
        filt = sorted(set(m[:80] for m in re.findall(r"(?:PushedFilters|PartitionFilters): \[[^\]]+\]", plan)))
        out.append(f"| {name} | {', '.join(ops)} | {'; '.join(f.replace('|', '/') for f in filt)} |")
    with open(os.path.join(root, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main(sys.argv)
