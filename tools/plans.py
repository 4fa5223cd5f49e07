"""Write the physical plan trees of key registered queries to PLANS.md.

Usage: python tools/plans.py [sf_dir]   (AQE off so codegen stages are visible)
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trendlens.plans.catalog import QUERIES  # noqa: E402
from trendlens.session import get_spark  # noqa: E402

KEY = ["dropna_rows", "first_child_left_join", "ols_two_feature", "ols_by_group", "corr_matrix",
       "interaction_cells_d2", "lump_topn", "linear_cv_r2"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    out = ["# Physical plans of key queries",
           "",
           f"Generated by `tools/plans.py` on `{os.path.basename(sf)}` with AQE off (so whole-stage codegen",
           "stages `*(n)` are visible; with AQE on, join strategies are re-decided at runtime from measured",
           "sizes). Long expression lists are cut at 160 characters.", ""]
    for name in KEY:
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        out += [f"## {name}", "", "```"]
        out += [line[:160] for line in plan.splitlines()]
        out += ["```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
