"""Print the physical plans described in PLANS.md.

Usage: python tools/explain.py [sf_dir]
Automatic broadcasts are turned off so tables that are large on a cluster
are planned as large here.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    args = sys.argv[1:]
    sf_dir = next((a for a in args if a.startswith("/")), "/root/testdata/sf0.01")
    from deficit_engine import get_session
    from deficit_engine.operators import drugs, report, scoring
    from deficit_engine.plans.context import STANDARD_WINDOWS, context
    spark = get_session("local[8]", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    c = context(spark, sf_dir)
    plans = {
        "event search (all windows)": c.search(c.slices(), lookbacks=STANDARD_WINDOWS,
                                               unique_categories=True),
        "hit table read": c.deficits("efi", 3, 3),
        "scores + band summary": report.summarize_bands(
            scoring.score_with_robust(c.deficits("vafi", 1, 1), c.cohort, 31, 0.10, 0.20)),
        "polypharmacy": drugs.polypharmacy(
            drugs.exposures_in_window(c.drug_era(), c.cohort, latest=c.date_range(1)[1]), c.cohort, 10),
        "category table": report.summarize_categories(c.deficits("vafi", 1, 1), c.cohort,
                                                      c.category_names(), unit_score=True),
    }
    for name, df in plans.items():
        print(f"===== {name}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
