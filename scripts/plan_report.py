"""Physical-plan report for every registered query (or the ones named).

For each query: number of shuffle exchanges, broadcast exchanges, window
operators, Python (Arrow) operators, scans with their ReadSchema width, and
every `Exchange SinglePartition` together with the operator feeding it, so
single-task steps can be checked to run only over bounded inputs.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelspark.plans.catalog import queries  # noqa: E402
from labelspark.session import local_session  # noqa: E402


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main() -> None:
    sf = os.environ.get("PLAN_SF", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    spark = local_session(8, 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan
    for name, fn in queries().items():
        if names and name not in names:
            continue
        txt = plan_text(fn(spark, sf))
        lines = txt.splitlines()
        n_ex = sum(1 for ln in lines if re.search(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin)", ln))
        n_bc = sum(1 for ln in lines if "BroadcastExchange" in ln)
        n_win = sum(1 for ln in lines if re.search(r"\bWindow\b", ln) and "WindowGroupLimit" not in ln)
        n_py = sum(1 for ln in lines if re.search(r"MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas", ln))
        single = []
        for i, ln in enumerate(lines):
            if "Exchange SinglePartition" in ln and "ReusedExchange" not in ln:
                child = lines[i + 1].strip() if i + 1 < len(lines) else ""
                single.append(re.sub(r"#\d+L?", "", child)[:110])
        print(f"{name}: exchanges={n_ex} broadcasts={n_bc} windows={n_win} python={n_py} "
              f"single_partition={len(single)}")
        for s in single:
            print(f"    single-partition input: {s}")


if __name__ == "__main__":
    main()
