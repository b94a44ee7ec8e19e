"""Print the physical plan of registered queries (``explain('formatted')``)
with a one-line summary of the operators that matter at scale.

    python tools/explain_plans.py /root/testdata/sf0.1 search_filtered knn_join_grid
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vellum.catalog import QUERIES, load_all  # noqa: E402
from vellum.session import local_session  # noqa: E402

WATCH = ["WindowGroupLimit", "TakeOrderedAndProject", "BroadcastHashJoin", "SortMergeJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "MapInPandas", "FlatMapCoGroupsInPandas",
         "Exchange", "WholeStageCodegen"]


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    load_all()
    spark = local_session(8)
    for name in argv[2:] or ["search_filtered"]:
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"===== {name}")
        print({k: plan.count(k) for k in WATCH if plan.count(k)})
        df.explain("formatted")


if __name__ == "__main__":
    main(sys.argv)
