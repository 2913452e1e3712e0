"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each run uses a fresh materialisation tag, so the OMOP projection and the
persisted cohort / hit tables are rebuilt and timed (``prepare_omop`` and
inside the first queries that need them). Results go to a ``noop`` sink:
the full result is computed, nothing is pulled to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "cohort_clean",             # A1-A5, materialised
    "deficits_1y",              # C1-C11: all indices x both windows in one pass, materialised
    "band_summary_1y",          # E1 + E3
    "band_summary_3y",
    "category_summary_suppressed",  # E4 + E6 + E7
    "polypharmacy",             # D1-D3
    "band_summary_efi",         # EFI + polypharmacy (D8) + E1 + E3
    "poly_deciles",             # D7
    "source_code_hits",         # C12-C13
    "method_icc",               # E8-E9
    "survey_cohort",            # A6
    "demographics",             # A7
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from deficit_engine.session import get_session
    from deficit_engine.plans import context as ctxmod
    from deficit_engine.plans.queries import REGISTRY

    extra = {}
    if os.environ.get("BENCH_DRIVER_MEM"):
        extra["spark.driver.memory"] = os.environ["BENCH_DRIVER_MEM"]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), extra=extra)
    # a fresh run id: every materialised table is rebuilt and timed
    ctxmod.default_options(run_id=uuid.uuid4().hex[:8])
    times: dict[str, float] = {}

    t0 = time.time()
    ctxmod.context(spark, sf_dir)
    times["prepare_omop"] = round(time.time() - t0, 3)

    for name in HEADLINE:
        t1 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t1, 3)

    # value: the headline queries (cohort build, searches, polypharmacy,
    # scoring, reports, agreement). The one-off projection of the driver's
    # TPC-H-like tables into OMOP tables is reported beside it (prepare_omop).
    total = round(sum(v for k, v in times.items() if k != "prepare_omop"), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "prepare_sec": times["prepare_omop"],
                      "total_with_prepare_sec": round(sum(times.values()), 3),
                      "cpus": cpus, "n_queries": len(HEADLINE)}))
    spark.stop()


if __name__ == "__main__":
    main()
