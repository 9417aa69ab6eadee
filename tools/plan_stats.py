"""Per registered query: source scans, single-partition exchanges and
nested-loop / cartesian joins in the executed plan (after AQE).

Usage: python tools/plan_stats.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys

sys.path.insert(0, ".")
from metalens.plans.queries import REGISTRY  # noqa: E402
from metalens.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = get_spark()
    print(f"{'query':28s} scans single bnlj cartesian")
    for name in names:
        df = REGISTRY[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"{name:28s} {plan.count('FileScan'):5d} {plan.count('SinglePartition'):6d} "
              f"{plan.count('NestedLoopJoin'):4d} {plan.count('Cartesian'):9d}")
    spark.stop()


if __name__ == "__main__":
    main()
