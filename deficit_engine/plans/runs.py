"""End-to-end index runs that write the published report files.

``run_indices`` is the whole workflow for one input and the given cohorts:
one event-search pass for both window settings (shared, materialised hit
table), polypharmacy, scores, band summaries and category tables for VAFI and
EFI, written as CSV folders named
``{date}_{index}[_categories]_acute{a}-chronic{c}_{source}``.
Nothing is collected; every report is written by the executors.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from deficit_engine.constants import EFI, POLYPHARMACY_THRESHOLD, VAFI
from deficit_engine.operators import drugs, report, scoring
from deficit_engine.plans.context import COHORTS, STANDARD_WINDOWS, RunContext, context
from deficit_engine.sources.io import read_code_list, write_report


def run_indices(spark: SparkSession, sf_dir: str | None, out_dir: str, *, source: str = "fixture",
                run_date: str | None = None, windows=STANDARD_WINDOWS,
                poly_threshold: int = POLYPHARMACY_THRESHOLD, cohorts: Sequence[str] = ("claims",),
                run: RunContext | None = None, specs: Mapping[str, dict] | None = None,
                single_file: bool = False) -> list[str]:
    """Run VAFI, EFI and every other index that the context has a code list of,
    for every cohort and window setting, and write the reports; return paths.
    ``run``: a context on OMOP tables instead of ``sf_dir``. ``specs``:
    denominator, lb and ub of the other indices. ``single_file``: each report is
    one file ``<name>.csv`` instead of a folder."""
    run_date = run_date or _dt.date.today().isoformat()
    c = run if run is not None else context(spark, sf_dir)
    specs = {"vafi": VAFI, "efi": EFI, **(specs or {})}
    lacking = [fi for fi in c.indices if fi not in specs]
    if lacking:
        raise ValueError(f"no denominator and thresholds for {', '.join(lacking)}")
    written = []
    for of in cohorts:
        cohort = c.cohort_of(of)
        label = source if of == "claims" else f"{source}-{of}"
        # polypharmacy is always the one-year window, whatever the index window
        poly = drugs.polypharmacy(c.in_window(of=of), cohort, poly_threshold)
        for acute, chronic in windows:
            for fi in c.indices:
                spec, unit = specs[fi], fi == "vafi"
                hits = c.deficits(fi, acute, chronic, of)
                if fi == "efi":
                    hits = drugs.add_polypharmacy(hits, poly)
                scores = scoring.score_with_robust(hits, cohort, spec["denominator"], spec["lb"], spec["ub"])
                written.append(write_report(report.summarize_bands(scores), out_dir, index=fi,
                                            acute=acute, chronic=chronic, source=label,
                                            run_date=run_date, single_file=single_file))
                cats = report.category_report(hits, cohort, c.category_names(fi), unit_score=unit)
                written.append(write_report(cats, out_dir, index=fi, acute=acute, chronic=chronic,
                                            source=label, run_date=run_date, kind="categories", single_file=single_file))
    return written


def main(argv=None) -> None:
    """``python -m deficit_engine.plans.runs (--input DIR | --omop DIR | --schema NAME) --out DIR``"""
    import argparse
    from deficit_engine.session import get_session
    from deficit_engine.sources.omop import event_inputs, load_folder, load_schema
    ap = argparse.ArgumentParser(description="Run VAFI / EFI indices and write the reports")
    given = ap.add_mutually_exclusive_group(required=True)
    given.add_argument("--input", help="folder with the driver's parquet tables, projected to OMOP")
    given.add_argument("--omop", help="folder with OMOP parquet tables")
    given.add_argument("--schema", help="catalog schema with OMOP tables")
    ap.add_argument("--out", required=True, help="output folder for the CSV reports")
    ap.add_argument("--source", default="fixture", help="data source label in file names")
    ap.add_argument("--date", default=None, help="run date in file names (default today)")
    ap.add_argument("--code-list", action="append", default=[], metavar="INDEX=PATH",
                    help="code list of one index, as CSV (category, concept_id, score in the declared order) or Parquet")
    ap.add_argument("--index", action="append", default=[], metavar="NAME:DENOMINATOR:LOWER:UPPER",
                    help="denominator and thresholds of another index (with a --code-list of its own)")
    ap.add_argument("--single-file", action="store_true", help="one CSV file for each report instead of a folder")
    ap.add_argument("--cohort", action="append", choices=sorted(COHORTS), help="cohort (default claims)")
    args = ap.parse_args(argv)
    spark = get_session()
    lists = {fi: read_code_list(spark, path) for fi, _, path in (x.partition("=") for x in args.code_list)}
    if args.omop or args.schema:
        tables, inputs = load_folder(spark, args.omop) if args.omop else load_schema(spark, args.schema)
        years = event_inputs(spark, args.omop) if args.omop else None
        # event tables in year folders: what an earlier run made is brought up to date
        run = RunContext.from_tables(spark, tables, inputs, code_lists=lists, event_inputs=years, home=args.omop if years else None)
    else:
        run = RunContext(spark, args.input, code_lists=lists) if lists else None
    for p in run_indices(spark, args.input, args.out, source=args.source, run_date=args.date,
                         cohorts=args.cohort or ("claims",), run=run, single_file=args.single_file,
                         specs={n: {"denominator": int(d), "lb": float(lo), "ub": float(hi)} for n, d, lo, hi in (x.split(":") for x in args.index)}):
        print(p)


if __name__ == "__main__":
    main()
