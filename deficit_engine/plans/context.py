"""Per-input run context: tables, cohorts and code sets, built once.

Heavy intermediates (OMOP projections, the event store, the clean cohort) are
published in the shared checkpoint folder and read back - the analogue of the
persistent tables of the original workflow. The tables of a context are named
by a hash of its inputs (every file's path, length and time), of every option
that changes results (given code lists by their rows), and of the definitions
in this package, so neither another seed, nor replaced input, nor changed code
ever reuses an old table. Cohorts, events and hits are bucketed alike by
person, so what joins or sums them per person moves no rows.

With a ``home`` (inputs that stay in one place and grow) the event store and
the hit tables keep their names instead, and only what changed is done again;
see :mod:`deficit_engine.plans.incremental`.
"""

from __future__ import annotations

import hashlib
import pathlib
import threading
from collections.abc import Mapping
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deficit_engine.constants import AGE_BREAKS_CLAIMS, AGE_BREAKS_RESEARCH
from deficit_engine.operators import codes, cohort, drugs, events
from deficit_engine.operators.events import check_index
from deficit_engine.operators.skew import task_count
from deficit_engine.plans import incremental
from deficit_engine.sources.event_store import EventStore, Slices, bucket_count, open_store, update_store
from deficit_engine.sources.fixtures import OmopTables, input_fingerprint, omop_tables
from deficit_engine.sources.io import materialize, rows_fingerprint

PARTS = ("functions", "operators", "plans", "sources", "constants.py", "session.py")


def _code_version() -> str:
    h = hashlib.sha1()
    root = pathlib.Path(__file__).resolve().parents[1]
    for part in PARTS:
        for p in sorted([root / part] if part.endswith(".py") else (root / part).rglob("*.py")):
            h.update(p.read_bytes())
    return h.hexdigest()[:10]


CODE_VERSION = _code_version()
STANDARD_WINDOWS = ((1, 1), (3, 3))
INDICES = ("vafi", "efi")
# the cohorts an index is run on, and where a drug exposure's duration is counted from
COHORTS = {"claims": "start", "survey": "window_start"}
HIT_FOLDERS = ("index_name", "acute_lookback", "chronic_lookback")


def _over(found: Slices | DataFrame, search) -> DataFrame:
    """A search of the bucketed events and of those of heavy persons."""
    if isinstance(found, DataFrame):
        found = Slices(None, found)
    parts = [search(part, colocated) for part, colocated in ((found.light, True), (found.heavy, False)) if part is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class RunContext:
    """Inputs and shared intermediates for one input.

    ``tables`` are OMOP tables (:class:`OmopTables`); without them the driver
    tables in ``sf_dir`` are projected. ``inputs`` names what ``tables`` were
    read from, for the name of the written tables. ``home`` names where they
    lie, if the event store and hits are to be brought up to date instead of
    made anew, and ``event_inputs`` has the fingerprint of each year's event files.
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, *, seed: int = 42,
                 materialize_tables: bool = True, run_id: str | None = None,
                 tables: OmopTables | None = None, inputs: str | None = None,
                 code_lists: Mapping[str, DataFrame] | None = None, home: str | None = None,
                 event_inputs: Mapping[str, str] | None = None):
        self.spark, self.sf_dir, self.seed = spark, sf_dir, seed
        self.materialize_tables = materialize_tables
        self.code_lists = {check_index(fi): df for fi, df in (code_lists or {}).items()}
        # an index with a code list of its own is searched with the others
        self.indices = (*INDICES, *sorted(set(self.code_lists) - set(INDICES)))
        source = inputs if inputs is not None else input_fingerprint(spark, sf_dir)
        self.input_tag = f"{source}-{CODE_VERSION}" + (f"-{run_id}" if run_id else "")
        lists = "".join(f"{k}={rows_fingerprint(v)}" for k, v in sorted(self.code_lists.items()))
        self.options = hashlib.sha1(f"seed={seed};{lists}".encode()).hexdigest()[:10]
        self.tag = f"{self.input_tag}/{self.options}"
        self.home = f"home-{hashlib.sha1(home.encode()).hexdigest()[:16]}-{CODE_VERSION}" if home else None
        self.event_inputs = dict(event_inputs or {"": source})
        self.t = tables if tables is not None else \
            omop_tables(spark, sf_dir, materialize=materialize_tables, tag=self.input_tag)

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: OmopTables, inputs: str, **kw) -> RunContext:
        """A context on OMOP tables; see :func:`deficit_engine.sources.omop.load_omop`."""
        return cls(spark, tables=tables, inputs=inputs, **kw)

    def _memo(self, key, build):
        # one builder per key even if queries run from several threads: the
        # builders write shared, named tables
        with _LOCK:
            cache = self.__dict__.setdefault("_cache", {})
            if key not in cache:
                cache[key] = build()
            return cache[key]

    def _keep(self, df: DataFrame, name: str, partition_by: list[str] | None = None,
              by_person: bool = False, dealt: bool = False) -> DataFrame:
        """The published table ``name``; ``by_person``: in the event store's
        buckets; ``dealt``: its rows come in that partitioning already."""
        if not self.materialize_tables:
            return df
        if not by_person:
            return materialize(df, f"{self.tag}/{name}", partition_by=partition_by)
        if not dealt:
            df = df.repartition(self.buckets, "person_id")
        return materialize(df, f"{self.tag}/{name}", partition_by=partition_by, buckets=self.buckets, bucket_by=["person_id"])

    # --- code sets ---------------------------------------------------------
    def code_list(self, fi: str = "vafi") -> DataFrame:
        """The index's own code list, or the shared one."""
        return self.code_lists.get(check_index(fi), self.t.code_list)

    def code_set(self, fi: str = "vafi") -> DataFrame:
        """Searched code set (B1, lookback renamed chronic_category)."""
        return self._memo(("code_set", fi), lambda: codes.as_concept_location(
            codes.build_code_set(self.code_list(fi), self.t.lookbacks, fi)))

    def windows(self, fi: str = "vafi") -> DataFrame:
        """B2 output (concept_id, name, chronic_category)."""
        return self._memo(("windows", fi), lambda: self._keep(
            codes.resolve_standard(self.t.concept, self.code_set(fi)), f"windows_{fi}"))

    def categories(self, fi: str = "vafi") -> DataFrame:
        """(concept_id, category, score) of the code set."""
        return self.code_set(fi).select("concept_id", "category", "score")

    def category_names(self, fi: str = "vafi") -> DataFrame:
        """Categories that the index reports: its code list's, and the
        polypharmacy flag where the index has one."""
        names = self.code_list(fi).select("category")
        if fi == "efi":
            from deficit_engine.constants import POLYPHARMACY_CATEGORY
            names = names.unionByName(self.spark.range(1).select(F.lit(POLYPHARMACY_CATEGORY).alias("category")))
        return names.distinct()

    # --- cohorts -----------------------------------------------------------
    @property
    def raw_cohort(self) -> DataFrame:
        t = self.t
        return cohort.build_cohort(t.person, t.visit_occurrence, t.observation_period, self.seed)

    @property
    def cohort(self) -> DataFrame:
        """Clean claims-style cohort (A1-A5), materialised."""
        return self.cohort_of("claims")

    @property
    def research_cohort(self) -> DataFrame:
        """Survey-anchored cohort (A6), materialised."""
        return self.cohort_of("survey")

    def cohort_of(self, name: str) -> DataFrame:
        t = self.t
        if name == "claims":
            return self._memo(("cohort",), lambda: self._keep(
                cohort.clean_cohort(self.raw_cohort, AGE_BREAKS_CLAIMS), "cohort_clean", by_person=True))
        if name == "survey":
            return self._memo(("research_cohort",), lambda: self._keep(
                cohort.survey_cohort(t.ds_survey, t.cb_search_person, t.observation_period,
                                     AGE_BREAKS_RESEARCH), "cohort_survey", by_person=True))
        raise ValueError(f"no cohort {name!r}; known: {', '.join(COHORTS)}")

    def date_range(self, years: int, of: str = "claims") -> tuple:
        """Overall (earliest window start, latest index) of the cohort."""
        return self._memo(("date_range", years, of), lambda: events.date_bounds(
            events.search_frame(self.cohort_of(of)), years))

    # --- events ------------------------------------------------------------
    @property
    def _store_name(self) -> str:
        return f"{self.home or self.input_tag}/events"

    @property
    def buckets(self) -> int:
        """Buckets of the event store and of everything that is joined with it."""
        def count():
            there = open_store(self.spark, self._store_name)
            return there.buckets if there else bucket_count(self.spark, self.events().count())
        return self._memo(("buckets",), count)

    @property
    def store(self) -> EventStore:
        """The events of all domains in buckets by person."""
        return self._memo(("store",), lambda: update_store(
            self.events(with_source=True), self._store_name, self.event_inputs, buckets=self.buckets))

    def slices(self, with_source: bool = False, only: str | None = None) -> Slices:
        """Events of the store, or of the tables where nothing is materialised."""
        if not self.materialize_tables:
            return Slices(None, self.events(with_source, only))
        got = self.store.slices()
        return got if only is None else got.where(F.col("domain") == only)

    def events(self, with_source: bool = False, only: str | None = None) -> DataFrame:
        t = self.t
        tabs = {"condition": t.condition_occurrence, "observation": t.observation,
                "procedure": t.procedure_occurrence, "device": t.device_exposure}
        if only:
            tabs = {k: (v if k == only else None) for k, v in tabs.items()}
        return events.domain_events(**tabs, with_source=with_source)

    def search(self, found: Slices | DataFrame, fi: str = "vafi", of: str = "claims", members: DataFrame | None = None,
               **kw) -> DataFrame:
        """C1-C11 over a cohort (or some of its ``members``) with the run
        defaults (date bound, reused windows and categories). ``found``: events
        of the store, or any others."""
        settings = kw.get("lookbacks") or [(kw.get("acute", 1), kw.get("chronic", 1))]
        # defaults are built lazily: each one may run (small) jobs
        if "date_bound" not in kw:
            kw["date_bound"] = self.date_range(max(max(a, c) for a, c in settings), of)
        if "windows" not in kw and kw.get("join_to_concept", True):
            kw["windows"] = self.windows(fi)
        if "categories" not in kw:
            kw["categories"] = self.categories(fi)
        code_set = kw.pop("code_set", None)
        code_set = self.code_set(fi) if code_set is None else code_set
        people = self.cohort_of(of) if members is None else members
        return _over(found, lambda part, colocated: events.find_deficits(
            part, people, self.t.concept, code_set, colocated=colocated, **kw))

    def code_set_all(self) -> DataFrame:
        """Union of the index code sets, tagged with ``index_name``."""
        def build():
            out = None
            for fi in self.indices:
                one = self.code_set(fi).select("concept_id", "category", "score", "chronic_category",
                                               F.lit(fi).alias("index_name"))
                out = one if out is None else out.unionByName(one)
            return self._keep(out, "code_set_all")
        return self._memo(("code_set_all",), build)

    def windows_all(self) -> DataFrame:
        """Standard concepts of every index with their lookback."""
        return self._memo(("windows_all",), lambda: self._keep(
            codes.resolve_standard(self.t.concept, self.code_set_all(), tag="index_name"), "windows_all"))

    def search_all(self, found: Slices, of: str, members: DataFrame | None = None) -> DataFrame:
        """Unique-category hits of every index and both standard windows from one pass over events."""
        cs = self.code_set_all()
        return self.search(found, "vafi", of, members, code_set=cs, tag="index_name", windows=self.windows_all(),
                           categories=cs.select("concept_id", "index_name", "category", "score"),
                           lookbacks=STANDARD_WINDOWS, unique_categories=True)

    def hits_all(self, of: str = "claims") -> DataFrame:
        """Unique-category hits of EVERY index and BOTH standard windows from one
        pass over the events, published in the store's buckets - the
        persisted hit tables of the original workflow, built once per cohort."""
        def build():
            if self.home and self.materialize_tables:
                return incremental.refresh_hits(self, of)
            # one folder per (index, window): a report reads only its own slice
            found = self.slices()
            return self._keep(self.search_all(found, of), f"hits_all_indices_{of}", partition_by=list(HIT_FOLDERS),
                              by_person=True, dealt=found.heavy is None)
        return self._memo(("hits_all", of), build)

    def deficits(self, fi: str = "vafi", acute: int = 1, chronic: int = 1, of: str = "claims") -> DataFrame:
        """C11 deficit rows (person, strata, score, category) for one window."""
        if (acute, chronic) in STANDARD_WINDOWS and fi in self.indices:
            h = self.hits_all(of).filter((F.col("index_name") == fi) & (F.col("acute_lookback") == acute)
                                         & (F.col("chronic_lookback") == chronic))
        else:
            h = self.search(self.slices(), fi, of, acute=acute, chronic=chronic, unique_categories=True)
            # A person has at most (categories x scores) deficit rows, so hashing them
            # by person is skew-safe; what follows reuses this one partitioning.
            h = h.repartition("person_id")
        # published hits lie in buckets by person: the distinct here and the
        # per-person sums and joins downstream move none of them
        return events.deficit_rows(h)

    def source_events(self) -> DataFrame:
        """C12 rows of the claims cohort, searched and written once."""
        def build():
            found = self.slices(with_source=True)
            rows = _over(found, lambda part, colocated: events.source_code_search(
                part, self.cohort, self.t.concept, codes.source_code_set(self.t.source_codes),
                date_bound=self.date_range(1), colocated=colocated))
            return self._keep(rows, "source_events", by_person=True, dealt=found.heavy is None)
        return self._memo(("source_events",), build)

    # --- drugs ---------------------------------------------------------------
    def exposure_bounds(self, of: str = "claims") -> dict:
        """Dates outside which no exposure is in a one-year window of the cohort. A
        window may start a day before the lookback date (29 February)."""
        lo, hi = self.date_range(1, of)
        return {"earliest": lo - timedelta(days=1), "latest": hi} if lo else {}

    def ingredient_map(self) -> DataFrame:
        return self._memo(("ing",), lambda: self._keep(
            codes.ingredient_descendants(self.t.concept, self.t.concept_ancestor), "ingredient_map"))

    def exclusions(self) -> DataFrame:
        return codes.ancestor_exclusion_set(self.t.concept, self.t.concept_ancestor) \
            .select("ingredient_concept_id")

    def drug_era(self, strict_supply: bool = False) -> DataFrame:
        """D1 rebuilt exposures."""
        t = self.t
        return drugs.rebuild_drug_era(t.drug_exposure, t.concept, t.concept_ancestor,
                                      strict_supply=strict_supply,
                                      ingredient_map=self.ingredient_map(),
                                      exclusions=self.exclusions())

    def built_eras(self, exposures: DataFrame) -> DataFrame:
        """D5 eras of rebuilt exposures, in tasks that do not grow with them."""
        tasks = self._memo(("era_tasks",), lambda: task_count(self.spark, self.t.drug_exposure.count()))
        return drugs.build_drug_eras(exposures, tasks=tasks)

    def in_window(self, strict_supply: bool = False, of: str = "claims") -> DataFrame:
        """D2 exposures in the one-year window, materialised once (the
        persisted polypharmacy input of the original workflow). The survey
        cohort counts durations from the window start."""
        rule = COHORTS[of]
        return self._memo(("in_window", strict_supply, of), lambda: self._keep(
            drugs.exposures_in_window(self.drug_era(strict_supply), self.cohort_of(of), duration_from=rule,
                                      **self.exposure_bounds(of)),
            f"drug_in_window_{of}_{int(strict_supply)}"))


_CONTEXTS: dict[tuple, RunContext] = {}
_INPUTS: dict[tuple, str] = {}
_LOCK = threading.RLock()


_DEFAULTS: dict = {}


def default_options(**kw) -> None:
    """Options applied to every later :func:`context` call (e.g. a fresh
    ``run_id`` so a benchmark rebuilds every materialised table)."""
    _DEFAULTS.update(kw)


def context(spark: SparkSession, sf_dir: str, *, refresh: bool = False, **kw) -> RunContext:
    """Cached :class:`RunContext` per (session, input folder, options). The input
    files are listed once for a folder; ``refresh`` lists them again."""
    kw = {**_DEFAULTS, **kw}
    folder = (id(spark), spark.sparkContext.applicationId, sf_dir)
    with _LOCK:
        if refresh or folder not in _INPUTS:
            _INPUTS[folder] = input_fingerprint(spark, sf_dir)
        key = (*folder, _INPUTS[folder], tuple(sorted(kw.items())))
        ctx = _CONTEXTS.get(key)
        if ctx is None:
            ctx = _CONTEXTS[key] = RunContext(spark, sf_dir, inputs=_INPUTS[folder], **kw)
        return ctx
