"""OMOP-shaped clinical tables projected from the driver's TPC-H-like tables.

The driver ships no clinical tables, so each OMOP input is a deterministic
projection of ``customer / nation / region / orders / lineitem / part``
(documented in FIXTURES.md). The projection is written once per input folder
under the shared checkpoint folder (the Spark analogue of the warehouse
tables the original workflow reads) and then read back as plain Parquet, so
every query scans real tables with pushdown instead of re-deriving them.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deficit_engine.constants import ANTIBIOTIC_ANCESTOR_ID
from deficit_engine.operators.skew import task_count
from deficit_engine.session import checkpoint_dir
from deficit_engine.sources.io import files_fingerprint, table_exists

DOMAINS = {  # domain code of a projected event -> OMOP table / column prefix
    1: ("condition_occurrence", "condition_concept_id", "condition_start_date",
        "condition_source_value"),
    2: ("observation", "observation_concept_id", "observation_date",
        "observation_source_value"),
    3: ("procedure_occurrence", "procedure_concept_id", "procedure_date",
        "procedure_source_value"),
    0: ("device_exposure", "device_concept_id", "device_exposure_start_date",
        "device_source_value"),
}


# projections/filters of the written line-item table: not copied again
VIEWS_OF_LINES = frozenset(t for t, *_ in DOMAINS.values()) | {"drug_exposure"}


@dataclass
class OmopTables:
    person: DataFrame
    visit_occurrence: DataFrame
    observation_period: DataFrame
    condition_occurrence: DataFrame
    observation: DataFrame
    procedure_occurrence: DataFrame
    device_exposure: DataFrame
    drug_exposure: DataFrame
    drug_era: DataFrame
    concept: DataFrame
    concept_ancestor: DataFrame
    code_list: DataFrame
    lookbacks: DataFrame
    source_codes: DataFrame
    ds_survey: DataFrame
    cb_search_person: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _d(c: str):
    return F.col(c).cast("date")


def _i(c):
    return (F.col(c) if isinstance(c, str) else c).cast("int")


def project(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame | int]:
    """Lazy projections of the driver tables into the OMOP inputs, and the
    number of tasks (``tasks``) that the line items are dealt over."""
    customer = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    part = _read(spark, sf_dir, "part")

    person = (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
              .select(F.col("c_custkey").alias("person_id"),
                      _i(F.lit(1920) + F.col("c_custkey") % 50).alias("year_of_birth"),
                      F.when(F.col("c_nationkey") % 2 == 0, 8507).otherwise(8532)
                      .cast("int").alias("gender_concept_id"),
                      _i(F.lit(2000000) + F.col("n_regionkey")).alias("race_concept_id"),
                      _i(F.lit(3000000) + F.col("c_custkey") % 3).alias("ethnicity_concept_id")))

    visit = orders.select(F.col("o_orderkey").alias("visit_occurrence_id"),
                          F.col("o_custkey").alias("person_id"),
                          _d("o_orderdate").alias("visit_start_date"))

    # One scan/join of the line items feeds every event-like table.
    tasks, owners = task_count(spark, lineitem.count()), orders.select("o_orderkey", "o_custkey")
    if tasks > task_count(spark, 0):    # large: a join sorts a bounded number of rows in a task
        lineitem, owners = lineitem.repartition(tasks, "l_orderkey"), owners.repartition(tasks, "o_orderkey")
    lines = (lineitem.join(owners, lineitem.l_orderkey == owners.o_orderkey)
             .select(F.col("o_custkey").alias("person_id"), "l_orderkey", "l_partkey",
                     "l_linenumber", _d("l_shipdate").alias("ship_date"), "l_returnflag",
                     "l_quantity", (F.col("l_linenumber") % 4).alias("domain"),
                     F.year("l_shipdate").alias("event_year")))

    brand_no = _i(F.substring("p_brand", 7, 1 << 20))
    ingredient = part.select(brand_no.alias("b")).distinct()
    return {"person": person, "visit_occurrence": visit, "lines": lines, "part": part,
            "ingredient": ingredient, "region": region, "customer": customer,
            "orders": orders, "tasks": tasks}


def _derived(spark: SparkSession, base: dict[str, DataFrame | int]) -> dict[str, DataFrame]:
    lines, part, ingredient, region = base["lines"], base["part"], base["ingredient"], base["region"]
    visit, customer, orders = base["visit_occurrence"], base["customer"], base["orders"]
    out: dict[str, DataFrame] = {"person": base["person"], "visit_occurrence": visit}

    # every fourth person has two periods: the first ends, and the second starts, halfway
    spans = visit.groupBy("person_id").agg(F.min("visit_start_date").alias("lo"), F.max("visit_start_date").alias("hi")) \
        .withColumn("mid", F.date_add("lo", F.floor(F.datediff("hi", "lo") / 2).cast("int")))
    two = F.col("person_id") % 4 == 0
    out["observation_period"] = spans.select(
        "person_id", F.col("lo").alias("observation_period_start_date"),
        F.when(two, F.col("mid")).otherwise(F.col("hi")).alias("observation_period_end_date")).unionByName(
        spans.filter(two).select("person_id", F.col("mid").alias("observation_period_start_date"),
                                 F.col("hi").alias("observation_period_end_date")))

    ev = lines.select("person_id", _i("l_partkey").alias("concept_id"),
                      F.col("ship_date").alias("start_date"),
                      F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("source_value"),
                      "domain", "event_year")
    for code, (table, cid, date, src) in DOMAINS.items():
        out[table] = ev.filter(F.col("domain") == code).select(
            "person_id", F.col("concept_id").alias(cid), F.col("start_date").alias(date),
            F.col("source_value").alias(src), "event_year")

    q = F.col("l_quantity")
    out["drug_exposure"] = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("drug_exposure_id"),
        "person_id",
        F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(_i("l_partkey"))
        .cast("int").alias("drug_concept_id"),
        F.col("ship_date").alias("drug_exposure_start_date"),
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("date"))
        .when(F.col("l_returnflag") == "R", F.col("ship_date"))
        .otherwise(F.date_add("ship_date", _i(q))).alias("drug_exposure_end_date"),
        F.when(q > 45, F.lit(None).cast("int")).when(q == 1, F.lit(-1))
        .when(q == 2, F.lit(0)).otherwise(_i(q)).cast("int").alias("days_supply"))

    # few lines share a (person, drug): reducing them before the shuffle would
    # fill and spill a hash table of nearly all lines, and save nothing
    out["drug_era"] = lines.repartition(base["tasks"], "person_id", "l_partkey").groupBy("person_id", "l_partkey").agg(
        F.min("ship_date").alias("drug_era_start_date"),
        F.date_add(F.max("ship_date"), 30).alias("drug_era_end_date")).select(
        "person_id", _i("l_partkey").alias("drug_concept_id"), "drug_era_start_date",
        "drug_era_end_date")

    d1970, d2099 = F.lit("1970-01-01").cast("date"), F.lit("2099-12-31").cast("date")
    out["concept"] = (
        part.select(_i("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_name"),
                    F.when(F.col("p_partkey") % 10 == 0, F.lit(None).cast("string"))
                    .otherwise(F.lit("S")).alias("standard_concept"),
                    F.lit("SNOMED").alias("vocabulary_id"),
                    F.lit("Clinical Finding").alias("concept_class_id"),
                    F.col("p_partkey").cast("string").alias("concept_code"),
                    d1970.alias("valid_start_date"), d2099.alias("valid_end_date"))
        .unionByName(ingredient.select(
            _i(F.lit(1000000) + F.col("b")).alias("concept_id"),
            F.concat(F.lit("ingredient "), F.col("b").cast("string")).alias("concept_name"),
            F.lit("S").alias("standard_concept"), F.lit("RxNorm").alias("vocabulary_id"),
            F.lit("Ingredient").alias("concept_class_id"),
            F.col("b").cast("string").alias("concept_code"), d1970.alias("valid_start_date"),
            F.when(F.col("b") == 7, F.lit("2020-01-01").cast("date")).otherwise(d2099)
            .alias("valid_end_date")))
        .unionByName(region.select(
            _i(F.lit(2000000) + F.col("r_regionkey")).alias("concept_id"),
            F.col("r_name").alias("concept_name"), F.lit("S").alias("standard_concept"),
            F.lit("Race").alias("vocabulary_id"), F.lit("Race").alias("concept_class_id"),
            F.col("r_regionkey").cast("string").alias("concept_code"),
            d1970.alias("valid_start_date"), d2099.alias("valid_end_date")))
        .unionByName(region.filter(F.col("r_regionkey") < 2).select(
            _i(F.lit(3000000) + F.col("r_regionkey")).alias("concept_id"),
            F.concat(F.lit("ethnicity "), F.col("r_name")).alias("concept_name"),
            F.lit("S").alias("standard_concept"), F.lit("Ethnicity").alias("vocabulary_id"),
            F.lit("Ethnicity").alias("concept_class_id"),
            F.col("r_regionkey").cast("string").alias("concept_code"),
            d1970.alias("valid_start_date"), d2099.alias("valid_end_date"))))

    brand_no = _i(F.substring("p_brand", 7, 1 << 20))
    out["concept_ancestor"] = (
        part.select(_i(F.lit(1000000) + brand_no).alias("ancestor_concept_id"),
                    _i("p_partkey").alias("descendant_concept_id"))
        .unionByName(ingredient.select(_i(F.lit(1000000) + F.col("b")).alias("ancestor_concept_id"),
                                       _i(F.lit(1000000) + F.col("b")).alias("descendant_concept_id")))
        .unionByName(ingredient.filter(F.col("b").isin(3, 7)).select(
            F.lit(ANTIBIOTIC_ANCESTOR_ID).cast("int").alias("ancestor_concept_id"),
            _i(F.lit(1000000) + F.col("b")).alias("descendant_concept_id"))))

    out["code_list"] = (
        part.select(_i("p_partkey").alias("concept_id"), F.col("p_brand").alias("category"),
                    F.when(F.col("p_brand") == "Brand#2", 0.5).when(F.col("p_brand") == "Brand#3", 0.25)
                    .otherwise(1.0).alias("score"))
        .unionByName(part.filter(F.col("p_size") == 50).select(
            _i("p_partkey").alias("concept_id"), F.lit("Multi").alias("category"),
            F.lit(1.0).alias("score"))))

    brand_name = F.concat(F.lit("Brand#"), F.col("b").cast("string"))
    out["lookbacks"] = (
        ingredient.filter(F.col("b") != 25).select(
            F.lit("vafi").alias("fi"), brand_name.alias("category"),
            F.when(F.col("b") % 2 == 0, 3).otherwise(1).cast("int").alias("lookback"))
        .unionByName(spark.range(1).select(F.lit("vafi").alias("fi"), F.lit("Multi").alias("category"),
                                           F.lit(3).cast("int").alias("lookback")))
        .unionByName(ingredient.select(F.lit("efi").alias("fi"), brand_name.alias("category"),
                                       F.lit(1).cast("int").alias("lookback"))))

    out["source_codes"] = part.filter(F.col("p_partkey") % 7 != 0).select(
        F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code"),
        F.col("p_brand").alias("deficit"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("ICD10CM")).otherwise(F.lit("PROC"))
        .alias("codetype"))

    out["ds_survey"] = orders.select(
        F.col("o_custkey").alias("person_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("The Basics"))
        .otherwise(F.lit("Lifestyle")).alias("survey"),
        # wall-clock timestamp (no zone): dates derived from it never depend
        # on the session time zone of whoever reads the written table
        F.col("o_orderdate").cast("timestamp_ntz").alias("survey_datetime"))

    k = F.col("c_custkey")
    out["cb_search_person"] = customer.select(
        k.alias("person_id"),
        F.when(k % 5 == 0, 0).otherwise(1).cast("int").alias("has_ehr_data"),
        F.when(k % 11 == 0, F.lit("Skip")).when(F.col("c_nationkey") % 2 == 0, F.lit("Male"))
        .otherwise(F.lit("Female")).alias("sex_at_birth"),
        F.make_date(_i(F.lit(1920) + k % 50), _i(F.lit(1) + k % 12), _i(F.lit(1) + k % 28))
        .alias("dob"))
    return out


INPUTS = ("customer", "nation", "region", "orders", "lineitem", "part")


def input_fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Hash of the path, length and time of every file of the input tables."""
    return files_fingerprint(spark, [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in INPUTS])


def omop_tables(spark: SparkSession, sf_dir: str, *, materialize: bool = True,
                tag: str | None = None) -> OmopTables:
    """OMOP inputs for ``sf_dir``.

    With ``materialize`` the projections are written once to
    ``<spark.checkpoint.dir>/omop/<fingerprint>/`` (skip-if-exists) and read
    back; otherwise they are returned as lazy plans over the driver tables.
    """
    base = project(spark, sf_dir)
    if materialize:
        root = f"{checkpoint_dir(spark)}/omop/{tag or input_fingerprint(spark, sf_dir)}"
        # the line-item x order join feeds six tables: write it once, one
        # folder per event domain and year, so the domain tables below are
        # partition-pruned projections of it rather than separate copies and
        # a date bound skips whole folders. Ranges of (domain, year, person)
        # keep a folder's files few and a person's events together.
        lines_path = f"{root}/_lines"
        if not table_exists(spark, lines_path):
            (base["lines"].repartitionByRange(base["tasks"], "domain", "event_year", "person_id")
             .sortWithinPartitions("domain", "event_year", "person_id")
             .write.mode("overwrite").partitionBy("domain", "event_year").parquet(lines_path))
        base["lines"] = spark.read.parquet(lines_path)
    tables = _derived(spark, base)
    if materialize:
        todo = [(n, df) for n, df in tables.items()
                if n not in VIEWS_OF_LINES and not table_exists(spark, f"{root}/{n}")]
        # independent small writes: submit them as concurrent Spark jobs
        with ThreadPoolExecutor(max_workers=8) as pool:
            list(pool.map(lambda nd: nd[1].write.mode("overwrite").parquet(f"{root}/{nd[0]}"), todo))
        tables = {n: (df if n in VIEWS_OF_LINES else spark.read.parquet(f"{root}/{n}"))
                  for n, df in tables.items()}
    return OmopTables(**{f.name: tables[f.name] for f in fields(OmopTables)})
