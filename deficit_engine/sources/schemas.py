"""Declared schemas of the clinical inputs (fail early on a missing column)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

L, I, D, S, TS, DB = (T.LongType(), T.IntegerType(), T.DateType(), T.StringType(),
                      T.TimestampNTZType(), T.DoubleType())


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "person": _schema(("person_id", L), ("year_of_birth", I), ("gender_concept_id", I),
                      ("race_concept_id", I), ("ethnicity_concept_id", I)),
    "visit_occurrence": _schema(("visit_occurrence_id", L), ("person_id", L),
                                ("visit_start_date", D)),
    "observation_period": _schema(("person_id", L), ("observation_period_start_date", D),
                                  ("observation_period_end_date", D)),
    "condition_occurrence": _schema(("person_id", L), ("condition_concept_id", I),
                                    ("condition_start_date", D), ("condition_source_value", S)),
    "observation": _schema(("person_id", L), ("observation_concept_id", I),
                           ("observation_date", D), ("observation_source_value", S)),
    "procedure_occurrence": _schema(("person_id", L), ("procedure_concept_id", I),
                                    ("procedure_date", D), ("procedure_source_value", S)),
    "device_exposure": _schema(("person_id", L), ("device_concept_id", I),
                               ("device_exposure_start_date", D), ("device_source_value", S)),
    "drug_exposure": _schema(("drug_exposure_id", L), ("person_id", L), ("drug_concept_id", I),
                             ("drug_exposure_start_date", D), ("drug_exposure_end_date", D),
                             ("days_supply", I)),
    "drug_era": _schema(("person_id", L), ("drug_concept_id", I), ("drug_era_start_date", D),
                        ("drug_era_end_date", D)),
    "concept": _schema(("concept_id", I), ("concept_name", S), ("standard_concept", S),
                       ("vocabulary_id", S), ("concept_class_id", S), ("concept_code", S),
                       ("valid_start_date", D), ("valid_end_date", D)),
    "concept_ancestor": _schema(("ancestor_concept_id", I), ("descendant_concept_id", I)),
    "code_list": _schema(("concept_id", I), ("category", S), ("score", DB)),
    "lookbacks": _schema(("fi", S), ("category", S), ("lookback", I)),
    "source_codes": _schema(("code", S), ("deficit", S), ("codetype", S)),
    "ds_survey": _schema(("person_id", L), ("survey", S), ("survey_datetime", TS)),
    "cb_search_person": _schema(("person_id", L), ("has_ehr_data", I), ("sex_at_birth", S),
                                ("dob", D)),
}


def require_columns(df: DataFrame, table: str) -> DataFrame:
    """Raise if ``df`` lacks a column the pipelines read from ``table``."""
    missing = [f.name for f in SCHEMAS[table].fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table} is missing columns {missing}")
    return df
