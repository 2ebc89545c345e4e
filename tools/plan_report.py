"""Execute every registered query and summarise its final (post-AQE) physical plan.

Writes PLANS.md: per query the number of shuffles, join strategies, per-group / global top-N
nodes, Python operators, and whether filters reached the scans.
"""
import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])
from learnlog.plans.queries import QUERIES  # noqa: E402
from learnlog.session import get_spark  # noqa: E402

NODES = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
         "CartesianProduct", "TakeOrderedAndProject", "WindowGroupLimit", "Window", "HashAggregate",
         "SortAggregate", "ObjectHashAggregate", "Generate", "MapInPandas", "PythonMapInArrow",
         "FlatMapGroupsInPandasWithState", "Expand"]


def final_section(plan: str) -> str:
    """AQE prints the final and the initial plan; keep the final one."""
    if "== Final Plan ==" in plan:
        plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return plan


def summarise(plan: str) -> dict:
    plan = final_section(plan)
    lines = plan.splitlines()
    ops = {}
    for n in NODES:
        c = sum(1 for line in lines if re.search(rf"(^|[-+:\s]){n}[\s(\[]", line + " "))
        if c:
            ops[n] = c
    return {
        "exchanges": sum(1 for line in lines if re.search(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", line)),
        "broadcasts": sum(1 for line in lines if "BroadcastExchange" in line),
        "reused": sum(1 for line in lines if "ReusedExchange" in line),
        "partition_filters": bool(re.search(r"PartitionFilters: \[[^\]]", plan)),
        "pushed_filters": bool(re.search(r"PushedFilters: \[[^\]]", plan)),
        "single_partition": "SinglePartition" in plan,
        "ops": ops,
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out = sys.argv[2] if len(sys.argv) > 2 else "PLANS.md"
    spark = get_spark()
    rows = []
    for name, fn in QUERIES.items():
        df = fn(spark, sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        ops = ", ".join(f"{k}x{v}" if v > 1 else k for k, v in s["ops"].items())
        rows.append(f"| `{name}` | {s['exchanges']} | {s['broadcasts']} | "
                    f"{'yes' if s['partition_filters'] else ''} | {'yes' if s['pushed_filters'] else ''} | "
                    f"{'**yes**' if s['single_partition'] else ''} | {ops} |")
        print(rows[-1], flush=True)
    with open(out, "w") as f:
        f.write("# Physical plans (final, after AQE)\n\n"
                f"Generated by `tools/plan_report.py` on `{sf}` (`local[8]`). Columns: shuffle exchanges, "
                "broadcast exchanges, partition pruning on the history table, filters pushed into a "
                "scan, any single-partition exchange, and the notable operators.\n\n"
                "| Query | Shuffles | Broadcasts | Partition filters | Pushed filters | Single partition | Operators |\n"
                "| --- | --- | --- | --- | --- | --- | --- |\n")
        f.write("\n".join(rows) + "\n")
        f.write("\nNotes. A single-partition exchange appears only under a global aggregate "
                "(a total or a max) and carries one partial result per task. Joins of the small "
                "per-language tables stay sort-merge joins when they are full outer (no broadcast "
                "form exists for full outer); they hold a handful of rows. At this scale AQE "
                "broadcasts the small sides it measures; at large scale the same plans keep their "
                "shuffle joins. Python operators appear only in the model, file and stream-state "
                "queries.\n")


if __name__ == "__main__":
    main()
