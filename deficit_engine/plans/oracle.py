"""Independent SQL (DuckDB dialect) for every registered query.

The base views are the fixture projections of FIXTURES.md; the rest is a
direct, literal SQL rendering of each operator's specification (per-domain
searches, anti-join + union scoring, expand-grid category table, textbook
ICC), deliberately *not* the plan shapes of the Spark code, so agreement
between the two is evidence of correctness. Each query is emitted as one
``WITH`` statement containing only the views it references.
"""

from __future__ import annotations

import re

# stated here too, so that a wrong constant in the library shows
AGE_BREAKS_CLAIMS = (40, 45, 50, 55, 60, 65, 70, 75, 80, 100)
AGE_BREAKS_RESEARCH = (40, 45, 50, 55, 60, 65, 70, 75, 80, 120)
DECILE_PROBS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> str:
    CTES[name] = body.strip()
    return name


# --- fixture projections (FIXTURES.md section 2) --------------------------------
cte("person", """
SELECT c_custkey AS person_id, CAST(1920 + c_custkey % 50 AS INT) AS year_of_birth,
       CASE WHEN c_nationkey % 2 = 0 THEN 8507 ELSE 8532 END AS gender_concept_id,
       CAST(2000000 + n_regionkey AS INT) AS race_concept_id,
       CAST(3000000 + c_custkey % 3 AS INT) AS ethnicity_concept_id
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
cte("visit_occurrence", """
SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id,
       CAST(o_orderdate AS DATE) AS visit_start_date FROM orders""")
cte("o_span", """
SELECT person_id, MIN(visit_start_date) AS lo, MAX(visit_start_date) AS hi,
       MIN(visit_start_date) + CAST(floor(date_diff('day', MIN(visit_start_date), MAX(visit_start_date)) / 2) AS INT) AS mid
FROM visit_occurrence GROUP BY person_id""")
cte("observation_period", """
SELECT person_id, lo AS observation_period_start_date,
       CASE WHEN person_id % 4 = 0 THEN mid ELSE hi END AS observation_period_end_date FROM o_span
UNION ALL
SELECT person_id, mid, hi FROM o_span WHERE person_id % 4 = 0""")
cte("clinical_event", """
SELECT o_custkey AS person_id, CAST(l_partkey AS INT) AS concept_id,
       CAST(l_shipdate AS DATE) AS start_date,
       concat('C', CAST(l_partkey AS STRING)) AS source_value, l_linenumber % 4 AS domain
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("condition_occurrence", """
SELECT person_id, concept_id AS condition_concept_id, start_date AS condition_start_date,
       source_value AS condition_source_value FROM clinical_event WHERE domain = 1""")
cte("observation", """
SELECT person_id, concept_id AS observation_concept_id, start_date AS observation_date,
       source_value AS observation_source_value FROM clinical_event WHERE domain = 2""")
cte("procedure_occurrence", """
SELECT person_id, concept_id AS procedure_concept_id, start_date AS procedure_date,
       source_value AS procedure_source_value FROM clinical_event WHERE domain = 3""")
cte("device_exposure", """
SELECT person_id, concept_id AS device_concept_id, start_date AS device_exposure_start_date,
       source_value AS device_source_value FROM clinical_event WHERE domain = 0""")
cte("drug_exposure", """
SELECT l_orderkey * 10 + l_linenumber AS drug_exposure_id, o_custkey AS person_id,
       CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_partkey AS INT) END AS drug_concept_id,
       CAST(l_shipdate AS DATE) AS drug_exposure_start_date,
       CASE WHEN l_returnflag = 'N' THEN NULL
            WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE)
            ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) END AS drug_exposure_end_date,
       CASE WHEN l_quantity > 45 THEN NULL WHEN l_quantity = 1 THEN -1
            WHEN l_quantity = 2 THEN 0 ELSE CAST(l_quantity AS INT) END AS days_supply
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("drug_era", """
SELECT o_custkey AS person_id, CAST(l_partkey AS INT) AS drug_concept_id,
       MIN(CAST(l_shipdate AS DATE)) AS drug_era_start_date,
       MAX(CAST(l_shipdate AS DATE)) + 30 AS drug_era_end_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""")
cte("ingredient", "SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS b FROM part")
cte("concept", """
SELECT CAST(p_partkey AS INT) AS concept_id, p_name AS concept_name,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 'S' END AS standard_concept,
       'SNOMED' AS vocabulary_id, 'Clinical Finding' AS concept_class_id,
       CAST(p_partkey AS STRING) AS concept_code,
       DATE '1970-01-01' AS valid_start_date, DATE '2099-12-31' AS valid_end_date
FROM part
UNION ALL
SELECT 1000000 + b, concat('ingredient ', CAST(b AS STRING)), 'S', 'RxNorm', 'Ingredient',
       CAST(b AS STRING), DATE '1970-01-01',
       CASE WHEN b = 7 THEN DATE '2020-01-01' ELSE DATE '2099-12-31' END
FROM ingredient
UNION ALL
SELECT CAST(2000000 + r_regionkey AS INT), r_name, 'S', 'Race', 'Race',
       CAST(r_regionkey AS STRING), DATE '1970-01-01', DATE '2099-12-31'
FROM region
UNION ALL
SELECT CAST(3000000 + r_regionkey AS INT), concat('ethnicity ', r_name), 'S', 'Ethnicity', 'Ethnicity',
       CAST(r_regionkey AS STRING), DATE '1970-01-01', DATE '2099-12-31'
FROM region WHERE r_regionkey < 2""")
cte("concept_ancestor", """
SELECT 1000000 + CAST(substr(p_brand, 7) AS INT) AS ancestor_concept_id,
       CAST(p_partkey AS INT) AS descendant_concept_id FROM part
UNION ALL
SELECT 1000000 + b, 1000000 + b FROM ingredient
UNION ALL
SELECT 21602796, 1000000 + b FROM ingredient WHERE b IN (3, 7)""")
cte("code_list", """
SELECT CAST(p_partkey AS INT) AS concept_id, p_brand AS category,
       CAST(CASE p_brand WHEN 'Brand#2' THEN 0.5 WHEN 'Brand#3' THEN 0.25 ELSE 1 END AS DOUBLE) AS score FROM part
UNION ALL
SELECT CAST(p_partkey AS INT), 'Multi', CAST(1 AS DOUBLE) FROM part WHERE p_size = 50""")
cte("lookbacks", """
SELECT 'vafi' AS fi, concat('Brand#', CAST(b AS STRING)) AS category,
       CASE WHEN b % 2 = 0 THEN 3 ELSE 1 END AS lookback
FROM ingredient WHERE b <> 25
UNION ALL
SELECT 'vafi', 'Multi', 3
UNION ALL
SELECT 'efi', concat('Brand#', CAST(b AS STRING)), 1 FROM ingredient""")
cte("source_codes", """
SELECT concat('C', CAST(p_partkey AS STRING)) AS code, p_brand AS deficit,
       CASE WHEN p_partkey % 2 = 0 THEN 'ICD10CM' ELSE 'PROC' END AS codetype
FROM part WHERE p_partkey % 7 <> 0""")
cte("ds_survey", """
SELECT o_custkey AS person_id,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'The Basics' ELSE 'Lifestyle' END AS survey,
       o_orderdate AS survey_datetime
FROM orders""")
cte("cb_search_person", """
SELECT c_custkey AS person_id, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS has_ehr_data,
       CASE WHEN c_custkey % 11 = 0 THEN 'Skip'
            WHEN c_nationkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex_at_birth,
       make_date(CAST(1920 + c_custkey % 50 AS INT), CAST(1 + c_custkey % 12 AS INT),
                 CAST(1 + c_custkey % 28 AS INT)) AS dob
FROM customer""")


# --- helpers ----------------------------------------------------------------------
def band(col: str, breaks) -> str:
    parts = []
    pairs = list(zip(breaks[:-1], breaks[1:]))
    for i, (lo, hi) in enumerate(pairs):
        if i == len(pairs) - 1:
            parts.append(f"WHEN {col} >= {lo} AND {col} <= {hi} THEN '[{lo},{hi}]'")
        else:
            parts.append(f"WHEN {col} >= {lo} AND {col} < {hi} THEN '[{lo},{hi})'")
    return "CASE " + " ".join(parts) + " END"


def shift(col: str, years: int) -> str:
    return col if years == 1 else f"CAST({col} - INTERVAL {years - 1} YEAR AS DATE)"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# --- cohort -------------------------------------------------------------------------
SEEDS = {"": 42, "_s7": 7}
for _s, _seed in SEEDS.items():
    cte(f"o_pick{_s}", f"""
SELECT person_id, visit_occurrence_id, visit_start_date,
       row_number() OVER (PARTITION BY person_id
                          ORDER BY md5(concat_ws('-', CAST(person_id AS VARCHAR),
                                                 CAST(visit_occurrence_id AS VARCHAR), '{_seed}')),
                                   visit_occurrence_id) AS rn
FROM visit_occurrence""")
    cte(f"o_idx{_s}", f"""
SELECT p.person_id, v.visit_start_date AS index_date, p.year_of_birth, p.gender_concept_id
FROM person p JOIN o_pick{_s} v ON p.person_id = v.person_id WHERE v.rn = 1""")
    cte(f"o_hist{_s}", f"""
SELECT i.person_id, i.index_date, i.year_of_birth, i.gender_concept_id,
       op.observation_period_start_date, op.observation_period_end_date
FROM o_idx{_s} i JOIN observation_period op ON i.person_id = op.person_id
WHERE date_diff('day', op.observation_period_start_date, i.index_date) >= 365""")
    cte(f"o_cohort{_s}", f"""
SELECT person_id, year_of_birth, gender_concept_id, index_date, observation_period_start_date,
       observation_period_end_date, CAST(year(index_date) - year_of_birth AS INTEGER) AS age,
       CASE WHEN year_of_birth < 1938 THEN 1 WHEN year_of_birth >= 1938 THEN 0 END AS yob_imputed
FROM o_hist{_s} WHERE year(index_date) - year_of_birth >= 40""")
    cte(f"o_clean0{_s}", f"""
SELECT person_id,
       CASE WHEN gender_concept_id = 8507 THEN 0 WHEN gender_concept_id <> 8507 THEN 1 END AS is_female,
       {band('age2', AGE_BREAKS_CLAIMS)} AS age_group,
       CAST(index_date - INTERVAL 1 YEAR AS DATE) AS visit_lookback_date, index_date, yob_imputed
FROM (SELECT *, CASE WHEN yob_imputed = 1 THEN 84 WHEN yob_imputed <> 1 THEN age END AS age2
      FROM o_cohort{_s}) t""")
    cte(f"o_clean{_s}", f"""
SELECT DISTINCT c.* FROM o_clean0{_s} c
WHERE c.index_date = (SELECT min(x.index_date) FROM o_clean0{_s} x WHERE x.person_id = c.person_id)""")
cte("o_attr", """
SELECT 1 AS stage, 'persons' AS label, count(*) AS n FROM person
UNION ALL SELECT 2, 'with a visit', count(DISTINCT person_id) FROM o_idx
UNION ALL SELECT 3, 'with history', count(DISTINCT person_id) FROM o_hist
UNION ALL SELECT 4, 'age eligible', count(DISTINCT person_id) FROM o_cohort""")
cte("o_surv", """
SELECT person_id, CAST(min(survey_datetime) AS DATE) AS survey_date
FROM ds_survey WHERE survey = 'The Basics' GROUP BY person_id""")
cte("o_ehr", """
SELECT DISTINCT person_id, sex_at_birth, dob FROM cb_search_person WHERE has_ehr_data = 1""")
cte("o_observed", """
SELECT *, CAST(floor(((year(index_date) * 10000 + month(index_date) * 100 + day(index_date))
                     - (year(dob) * 10000 + month(dob) * 100 + day(dob))) / 10000) AS INTEGER) AS age
FROM (SELECT e.person_id, e.sex_at_birth, e.dob, s.survey_date, op.observation_period_start_date,
             op.observation_period_end_date,
             CAST(s.survey_date + INTERVAL 1 YEAR AS DATE) AS index_date
      FROM o_ehr e LEFT JOIN observation_period op ON e.person_id = op.person_id
      JOIN o_surv s ON e.person_id = s.person_id) t
WHERE index_date < observation_period_end_date AND survey_date > observation_period_start_date""")
cte("o_aged", "SELECT * FROM o_observed WHERE age >= 40")
cte("o_survey_cohort", f"""
SELECT person_id,
       CASE WHEN sex_at_birth = 'Male' THEN 0 WHEN sex_at_birth <> 'Male' THEN 1 END AS is_female,
       {band('age', AGE_BREAKS_RESEARCH)} AS age_group,
       survey_date AS visit_lookback_date, index_date
FROM o_aged""")
cte("o_sattr", """
SELECT 1 AS stage, 'surveyed' AS label, count(*) AS n FROM o_surv
UNION ALL SELECT 2, 'participants', count(*) FROM cb_search_person
UNION ALL SELECT 3, 'with ehr', count(*) FROM o_ehr
UNION ALL SELECT 4, 'observed', count(*) FROM o_observed
UNION ALL SELECT 5, 'age eligible', count(*) FROM o_aged""")

# --- code sets and searches -----------------------------------------------------------
for _fi in ("vafi", "efi"):
    cte(f"o_cset_{_fi}", f"""
SELECT c.category, c.concept_id, c.score, l.fi, l.lookback
FROM code_list c LEFT JOIN (SELECT fi, category, lookback FROM lookbacks WHERE fi = '{_fi}') l
  ON c.category = l.category""")
    cte(f"o_cs_{_fi}", f"""
SELECT category, concept_id, score, fi, lookback AS chronic_category FROM o_cset_{_fi}""")
    cte(f"o_std_{_fi}", f"""
SELECT s.concept_id, s.name, k.chronic_category
FROM (SELECT DISTINCT concept_id, concept_name AS name FROM concept WHERE standard_concept = 'S') s
JOIN (SELECT DISTINCT concept_id, chronic_category FROM o_cs_{_fi}) k ON s.concept_id = k.concept_id""")

for _of, _cohort in (("", "o_clean"), ("_s7", "o_clean_s7"), ("_survey", "o_survey_cohort")):
    cte(f"o_pid{_of}", f"""
SELECT person_id, visit_lookback_date AS person_start_date, index_date AS person_end_date,
       age_group, is_female FROM {_cohort}""")
cte("o_ev", """
SELECT 'condition' AS domain, person_id, condition_concept_id AS concept_id,
       condition_start_date AS start_date, condition_source_value AS source_value
FROM condition_occurrence
UNION ALL SELECT 'observation', person_id, observation_concept_id, observation_date,
       observation_source_value FROM observation
UNION ALL SELECT 'procedure', person_id, procedure_concept_id, procedure_date,
       procedure_source_value FROM procedure_occurrence
UNION ALL SELECT 'device', person_id, device_concept_id, device_exposure_start_date,
       device_source_value FROM device_exposure""")


def search(fi: str, acute: int, chronic: int, domain: str | None = None, of: str = "") -> str:
    """Per-domain distinct hits (before categories are attached)."""
    name = f"o_hit_{fi}_{acute}_{chronic}{of}" + (f"_{domain}" if domain else "")
    if name in CTES:
        return name
    where = f"WHERE e.domain = '{domain}'" if domain else ""
    cte(name, f"""
SELECT DISTINCT * FROM (
  SELECT e.domain, p.person_id, p.age_group, p.is_female, e.concept_id, s.name AS concept_name,
         e.start_date,
         CASE WHEN s.chronic_category = 3 THEN {shift('p.person_start_date', chronic)}
              WHEN s.chronic_category <> 3 THEN {shift('p.person_start_date', acute)} END
           AS person_start_date,
         p.person_end_date, s.chronic_category
  FROM o_ev e JOIN o_pid{of} p ON e.person_id = p.person_id
  JOIN o_std_{fi} s ON e.concept_id = s.concept_id {where}) t
WHERE start_date >= person_start_date AND start_date <= person_end_date""")
    return name


def hits_all(fi: str, acute: int, chronic: int, of: str = "") -> str:
    name = f"o_all_{fi}_{acute}_{chronic}{of}"
    if name not in CTES:
        cte(name, f"""
SELECT h.person_id, h.age_group, h.is_female, h.person_start_date, h.person_end_date,
       c.category, h.concept_id, c.score
FROM {search(fi, acute, chronic, of=of)} h LEFT JOIN o_cs_{fi} c ON h.concept_id = c.concept_id""")
    return name


def hits_unique(fi: str, acute: int, chronic: int, of: str = "") -> str:
    name = f"o_uniq_{fi}_{acute}_{chronic}{of}"
    if name not in CTES:
        cte(name, f"""
SELECT DISTINCT person_id, age_group, is_female, person_start_date, person_end_date, category, score
FROM {hits_all(fi, acute, chronic, of)}""")
    return name


def deficits(fi: str, acute: int, chronic: int, of: str = "") -> str:
    name = f"o_def_{fi}_{acute}_{chronic}{of}"
    if name not in CTES:
        cte(name, f"""
SELECT DISTINCT person_id, age_group, is_female, score, category
FROM {hits_unique(fi, acute, chronic, of)}""")
    return name


def score(hits: str, cohort_: str, den: int, lb: float, ub: float, left_closed: bool = False) -> str:
    name = f"o_score_{hits}_{den}_{str(lb).replace('.', '')}_{str(ub).replace('.', '')}_{int(left_closed)}"
    if name in CTES:
        return name
    if left_closed:
        pre, fr, rob = (f"fi >= {dbl(lb)} AND fi < {dbl(ub)}", f"fi >= {dbl(ub)}", f"fi < {dbl(lb)}")
    else:
        pre, fr, rob = (f"fi > {dbl(lb)} AND fi <= {dbl(ub)}", f"fi > {dbl(ub)}", f"fi <= {dbl(lb)}")
    cte(name, f"""
SELECT person_id, age_group, is_female, fi,
       CASE WHEN {pre} THEN 1 WHEN NOT ({pre}) THEN 0 END AS prefrail,
       CASE WHEN {fr} THEN 1 WHEN NOT ({fr}) THEN 0 END AS frail,
       CASE WHEN {rob} THEN 1 WHEN NOT ({rob}) THEN 0 END AS robust
FROM (SELECT person_id, age_group, is_female, sum(score) / {dbl(float(den))} AS fi
      FROM (SELECT DISTINCT person_id, is_female, age_group, score, category FROM {hits}) d
      GROUP BY person_id, age_group, is_female) s
UNION ALL
SELECT person_id, age_group, is_female, CAST(0 AS DOUBLE), 0, 0, 1 FROM {cohort_} c
WHERE NOT EXISTS (SELECT 1 FROM {hits} h WHERE h.person_id = c.person_id)""")
    return name


def bands(scores: str) -> str:
    return f"""
SELECT age_group, is_female, count(*) AS N, CAST(sum(prefrail) AS BIGINT) AS n_prefrail,
       CAST(sum(frail) AS BIGINT) AS n_frail, CAST(sum(robust) AS BIGINT) AS n_robust,
       sum(prefrail) / count(*) AS prefrail, sum(frail) / count(*) AS frail,
       sum(robust) / count(*) AS robust
FROM {scores} GROUP BY age_group, is_female"""


def categories(hits: str, cohort_: str, unit: bool, suppress: bool, flag: bool = False) -> str:
    s = "CAST(1 AS DOUBLE)" if unit else "score"
    listed = "SELECT category FROM code_list" + (" UNION SELECT 'Polypharmacy'" if flag else "")
    grid = f"""
SELECT c.age_group, c.is_female, k.category, count(*) AS N,
       sum(coalesce(h.score, 0)) AS "count", sum(coalesce(h.score, 0)) / count(*) AS percent
FROM {cohort_} c CROSS JOIN (SELECT DISTINCT category FROM ({listed}) l) k
LEFT JOIN (SELECT person_id, category, {s} AS score FROM {hits}) h
  ON h.person_id = c.person_id AND h.category = k.category
GROUP BY c.age_group, c.is_female, k.category"""
    out = f"""
SELECT * FROM ({grid}) g
WHERE age_group IS NOT NULL AND is_female IS NOT NULL AND category IS NOT NULL
  AND N IS NOT NULL AND "count" IS NOT NULL AND percent IS NOT NULL"""
    if suppress:
        out = f"""
SELECT age_group, is_female, category, N,
       CASE WHEN "count" < 20 THEN CAST(0 AS DOUBLE) ELSE "count" END AS "count",
       CASE WHEN "count" < 20 THEN CAST(0 AS DOUBLE) ELSE percent END AS percent
FROM ({out}) s"""
    return out


# --- polypharmacy --------------------------------------------------------------------
cte("o_ing", """
SELECT a.ancestor_concept_id AS ingredient_concept_id, a.descendant_concept_id
FROM concept c JOIN concept_ancestor a ON c.concept_id = a.ancestor_concept_id
WHERE c.concept_class_id = 'Ingredient' AND c.vocabulary_id = 'RxNorm'""")
cte("o_excl", """
SELECT c.concept_id AS ingredient_concept_id, c.concept_name AS ingredient_concept_name,
       c.concept_code AS ingredient_concept_code
FROM concept c JOIN concept_ancestor a ON c.concept_id = a.descendant_concept_id
WHERE a.ancestor_concept_id = 21602796 AND c.vocabulary_id = 'RxNorm'
  AND c.concept_class_id = 'Ingredient'
  AND DATE '2024-07-15' >= c.valid_start_date AND DATE '2024-07-15' <= c.valid_end_date""")
for _strict in (False, True):
    _sfx = "_strict" if _strict else ""
    _supply = "d.days_supply >= 0" if _strict else "(d.days_supply >= 0 OR d.days_supply IS NULL)"
    cte(f"o_era{_sfx}", f"""
SELECT d.drug_exposure_id, d.person_id, i.ingredient_concept_id, d.drug_exposure_start_date,
       CASE WHEN d.drug_exposure_end_date IS NOT NULL THEN d.drug_exposure_end_date
            WHEN d.days_supply IS NOT NULL AND d.days_supply > 0
              THEN d.drug_exposure_start_date + d.days_supply
            ELSE d.drug_exposure_start_date + 1 END AS drug_exposure_end_date,
       d.days_supply
FROM drug_exposure d JOIN o_ing i ON d.drug_concept_id = i.descendant_concept_id
WHERE d.drug_concept_id <> 0 AND {_supply}
  AND NOT EXISTS (SELECT 1 FROM o_excl x WHERE x.ingredient_concept_id = i.ingredient_concept_id)""")
    cte(f"o_win{_sfx}", f"""
SELECT e.person_id, e.ingredient_concept_id, e.drug_exposure_start_date, e.drug_exposure_end_date
FROM o_era{_sfx} e JOIN o_clean c ON e.person_id = c.person_id
WHERE ((e.drug_exposure_start_date >= CAST(c.index_date - INTERVAL 1 YEAR AS DATE)
        AND e.drug_exposure_start_date <= c.index_date)
    OR (e.drug_exposure_end_date >= CAST(c.index_date - INTERVAL 1 YEAR AS DATE)
        AND e.drug_exposure_end_date <= c.index_date))
  AND date_diff('day', e.drug_exposure_start_date, e.drug_exposure_end_date) >= 1""")
cte("o_win_ws", """
SELECT e.person_id, e.ingredient_concept_id, e.drug_exposure_start_date, e.drug_exposure_end_date
FROM o_era e JOIN o_clean c ON e.person_id = c.person_id
WHERE ((e.drug_exposure_start_date >= CAST(c.index_date - INTERVAL 1 YEAR AS DATE)
        AND e.drug_exposure_start_date <= c.index_date)
    OR (e.drug_exposure_end_date >= CAST(c.index_date - INTERVAL 1 YEAR AS DATE)
        AND e.drug_exposure_end_date <= c.index_date))
  AND date_diff('day', c.visit_lookback_date, e.drug_exposure_end_date) >= 1""")
cte("o_win_survey", """
SELECT e.person_id, e.ingredient_concept_id, e.drug_exposure_start_date, e.drug_exposure_end_date
FROM o_era e JOIN o_survey_cohort c ON e.person_id = c.person_id
WHERE ((e.drug_exposure_start_date >= CAST(c.index_date - INTERVAL 1 YEAR AS DATE)
        AND e.drug_exposure_start_date <= c.index_date)
    OR (e.drug_exposure_end_date >= CAST(c.index_date - INTERVAL 1 YEAR AS DATE)
        AND e.drug_exposure_end_date <= c.index_date))
  AND date_diff('day', c.visit_lookback_date, e.drug_exposure_end_date) >= 1""")
cte("o_win_era", """
SELECT d.person_id, d.drug_concept_id, d.drug_era_start_date, d.drug_era_end_date
FROM drug_era d JOIN o_clean c ON d.person_id = c.person_id
WHERE ((d.drug_era_start_date >= CAST(c.index_date - INTERVAL 1 YEAR AS DATE)
        AND d.drug_era_start_date <= c.index_date)
    OR (d.drug_era_end_date >= CAST(c.index_date - INTERVAL 1 YEAR AS DATE)
        AND d.drug_era_end_date <= c.index_date))
  AND date_diff('day', d.drug_era_start_date, d.drug_era_end_date) > 1""")
cte("o_icount", """
SELECT person_id, count(*) AS n
FROM (SELECT DISTINCT person_id, ingredient_concept_id FROM o_win) d GROUP BY person_id""")


def built(exposures: str) -> str:
    """Eras by gaps and islands over all exposures of a (person, ingredient) at once."""
    key = "PARTITION BY person_id, ingredient_concept_id ORDER BY s, e, drug_exposure_id"
    return f"""
SELECT person_id, ingredient_concept_id, min(s) AS drug_era_start_date, max(e) AS drug_era_end_date,
       count(*) AS drug_exposure_count, CAST(sum(gap) AS BIGINT) AS gap_days
FROM (SELECT *, sum(is_new) OVER ({key} ROWS UNBOUNDED PRECEDING) AS island,
             CASE WHEN is_new = 0 THEN greatest(date_diff('day', before, s), 0) ELSE 0 END AS gap
      FROM (SELECT *, CASE WHEN before IS NULL OR date_diff('day', before, s) > 30 THEN 1 ELSE 0 END AS is_new
            FROM (SELECT *, max(e) OVER ({key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
                  FROM (SELECT person_id, ingredient_concept_id, drug_exposure_id, drug_exposure_start_date AS s,
                               greatest(drug_exposure_start_date, drug_exposure_end_date) AS e FROM {exposures}) a) b) c) d
GROUP BY person_id, ingredient_concept_id, island"""


cte("o_built", built("o_era"))
cte("o_era_all", """
SELECT d.drug_exposure_id, d.person_id, i.b + 1000000 AS ingredient_concept_id, d.drug_exposure_start_date,
       CASE WHEN d.drug_exposure_end_date IS NOT NULL THEN d.drug_exposure_end_date
            WHEN d.days_supply > 0 THEN d.drug_exposure_start_date + d.days_supply
            ELSE d.drug_exposure_start_date + 1 END AS drug_exposure_end_date
FROM drug_exposure d
JOIN concept_ancestor a ON d.drug_concept_id = a.descendant_concept_id
JOIN ingredient i ON a.ancestor_concept_id = i.b + 1000000
WHERE d.drug_concept_id <> 0 AND (d.days_supply >= 0 OR d.days_supply IS NULL)""")
cte("o_built_all", built("o_era_all"))
cte("o_win_built", """
SELECT d.person_id, d.ingredient_concept_id
FROM o_built_all d JOIN o_clean c ON d.person_id = c.person_id
WHERE ((d.drug_era_start_date >= CAST(c.index_date - INTERVAL 1 YEAR AS DATE) AND d.drug_era_start_date <= c.index_date)
    OR (d.drug_era_end_date >= CAST(c.index_date - INTERVAL 1 YEAR AS DATE) AND d.drug_era_end_date <= c.index_date))
  AND date_diff('day', d.drug_era_start_date, d.drug_era_end_date) > 1""")


def poly(win: str, threshold: int, item: str = "ingredient_concept_id", cohort_: str = "o_clean") -> str:
    name = f"o_poly_{win}_{threshold}"
    if name not in CTES:
        cte(name, f"""
SELECT k.person_id, c.is_female, c.age_group, CAST(1 AS DOUBLE) AS score,
       'Polypharmacy' AS category
FROM (SELECT person_id, count(*) AS n FROM (SELECT DISTINCT person_id, {item} FROM {win}) d
      GROUP BY person_id HAVING count(*) >= {threshold}) k
JOIN {cohort_} c ON k.person_id = c.person_id""")
    return name


for _name, _years, _threshold in (("o_efi_poly", 1, 10), ("o_efi_poly_t5", 1, 5), ("o_efi_poly_3y", 3, 10)):
    cte(_name, f"""
SELECT DISTINCT person_id, age_group, is_female, score, category FROM (
  SELECT person_id, age_group, is_female, score, category FROM {deficits('efi', _years, _years)}
  UNION ALL
  SELECT person_id, age_group, is_female, score, category FROM {poly('o_win', _threshold)}) u""")

# --- source codes and agreement -----------------------------------------------------------
cte("o_src_codes", """
SELECT code AS icd_code, deficit, codetype FROM source_codes WHERE codetype = 'ICD10CM'
UNION ALL SELECT code, deficit, codetype FROM source_codes WHERE codetype <> 'ICD10CM'""")
cte("o_src_ev", """
SELECT DISTINCT e.domain, p.person_id, p.age_group, p.is_female, e.concept_id, c.concept_name,
       e.start_date, s.deficit, e.source_value, p.person_start_date, p.person_end_date,
       c.vocabulary_id
FROM o_ev e JOIN o_pid p ON e.person_id = p.person_id
JOIN o_src_codes s ON e.source_value = s.icd_code
LEFT JOIN concept c ON e.concept_id = c.concept_id
WHERE e.start_date >= p.person_start_date AND e.start_date <= p.person_end_date""")
cte("o_src_def", """
SELECT DISTINCT person_id, age_group, is_female, deficit AS category, CAST(1 AS DOUBLE) AS score
FROM o_src_ev""")
cte("o_tot", f"""
SELECT x.category, x.sum_score_x, y.sum_score_y
FROM (SELECT category, sum(score) AS sum_score_x FROM {deficits('vafi', 1, 1)} GROUP BY category) x
LEFT JOIN (SELECT category, sum(score) AS sum_score_y FROM o_src_def GROUP BY category) y
  ON x.category = y.category""")
cte("o_icc", """
SELECT n, msb, msw FROM (
  SELECT count(*) AS n,
         2 * sum(power((a + b) / 2 - g, 2)) / (count(*) - 1) AS msb,
         sum(power(a - (a + b) / 2, 2) + power(b - (a + b) / 2, 2)) / count(*) AS msw
  FROM (SELECT sum_score_x AS a, sum_score_y AS b,
               avg((sum_score_x + sum_score_y) / 2) OVER () AS g
        FROM o_tot WHERE sum_score_x IS NOT NULL AND sum_score_y IS NOT NULL) d) s""")
cte("o_icc_without", """
SELECT n, msb, msw FROM (
  SELECT count(*) AS n,
         2 * sum(power((a + b) / 2 - g, 2)) / (count(*) - 1) AS msb,
         sum(power(a - (a + b) / 2, 2) + power(b - (a + b) / 2, 2)) / count(*) AS msw
  FROM (SELECT sum_score_x AS a, sum_score_y AS b,
               avg((sum_score_x + sum_score_y) / 2) OVER () AS g
        FROM o_tot WHERE sum_score_x IS NOT NULL AND sum_score_y IS NOT NULL AND category <> 'Brand#1') d) s""")


def ibeta(x: str, a: str, b: str) -> str:
    """Regularised incomplete beta function by its hypergeometric series (all terms positive)."""
    return f"""(exp({a} * ln({x}) + {b} * ln(1 - ({x})) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / {a}
 * list_sum(list_transform(range(0, 4000), lambda i: exp(lgamma({a} + {b} + i) - lgamma({a} + {b})
                                                   - lgamma({a} + 1 + i) + lgamma({a} + 1) + i * ln({x})))))"""


def fq(p: str, d1: str, d2: str) -> str:
    """F quantile: the binary digits of x = d1 f / (d2 + d1 f), one after another."""
    steps = ", ".join(["CAST(0 AS DOUBLE)", *(f"power(0.5, {k})" for k in range(1, 51))])
    x = f"list_reduce([{steps}], lambda q, s: CASE WHEN {ibeta('(q + s)', f'({d1} / 2.0)', f'({d2} / 2.0)')} <= {p} THEN q + s ELSE q END)"
    return f"(SELECT {d2} * x / ({d1} * (1 - x)) FROM (SELECT {x} AS x) q)"


def pooled_report(fi: str, years: int, summary: str) -> str:
    return f"""
SELECT DATE '2025-08-14' AS run_date, '{fi}' AS index_name, '' AS kind, {years} AS acute, {years} AS chronic,
       'fixture_set' AS source, CAST(sum(N) AS BIGINT) AS N, sum(n_robust) / sum(N) AS robust,
       sum(n_prefrail) / sum(N) AS prefrail, sum(n_frail) / sum(N) AS frail
FROM ({summary}) b"""


def pooled_category_report(fi: str, table: str) -> str:
    return f"""
SELECT DATE '2025-08-14' AS run_date, '{fi}' AS index_name, 'categories' AS kind, 1 AS acute, 1 AS chronic,
       'fixture_set' AS source, category, CAST(sum(N) AS BIGINT) AS N, sum("count") AS "count",
       sum("count") / sum(N) AS percent
FROM ({table}) b GROUP BY category"""


# --- the query texts ------------------------------------------------------------------------
V, E = "vafi", "efi"
SCORE_1 = score(deficits(V, 1, 1), "o_clean", 31, 0.10, 0.20)
SCORE_3 = score(deficits(V, 3, 3), "o_clean", 31, 0.10, 0.20)
SCORE_LC = score(deficits(V, 1, 1), "o_clean", 31, 0.11, 0.21, left_closed=True)
SCORE_EFI = score("o_efi_poly", "o_clean", 36, 0.12, 0.24)
SCORE_EFI_T5 = score("o_efi_poly_t5", "o_clean", 36, 0.12, 0.24)
SCORE_EFI_3 = score("o_efi_poly_3y", "o_clean", 36, 0.12, 0.24)
SCORE_SRC = score("o_src_def", "o_clean", 31, 0.11, 0.21)
SURVEY = {y: deficits(V, y, y, "_survey") for y in (1, 3)}
SCORE_SURVEY = {y: score(SURVEY[y], "o_survey_cohort", 31, 0.10, 0.20) for y in (1, 3)}
cte("o_bands_1", bands(SCORE_1))
PROBS = ", ".join(f"CAST({p!r} AS DOUBLE)" for p in DECILE_PROBS)
DOMAIN_COLS = ("person_id, age_group, is_female, concept_id, concept_name, start_date, "
               "person_start_date, person_end_date, chronic_category")

QUERIES: dict[str, str] = {
    "cohort_index": "SELECT * FROM o_cohort",
    "cohort_clean": "SELECT * FROM o_clean",
    "cohort_attrition": "SELECT * FROM o_attr",
    "survey_cohort": "SELECT * FROM o_survey_cohort",
    "survey_attrition": "SELECT * FROM o_sattr",
    "attrition_exclusions": """
SELECT source, stage, n, CAST(lag(n) OVER (PARTITION BY source ORDER BY stage) - n AS BIGINT) AS excluded
FROM (SELECT 'claims' AS source, stage, n FROM o_attr
      UNION ALL SELECT 'survey', stage, n FROM o_sattr) u""",
    "demographics": """
SELECT c.person_id, c.is_female, c.age_group, r.race, r.ethnicity
FROM o_survey_cohort c LEFT JOIN (
  SELECT p.person_id, rc.concept_name AS race, ec.concept_name AS ethnicity
  FROM person p LEFT JOIN concept rc ON p.race_concept_id = rc.concept_id
  LEFT JOIN concept ec ON p.ethnicity_concept_id = ec.concept_id) r ON c.person_id = r.person_id""",
    "cohort_composition": """
SELECT age_group, is_female, count(*) AS n,
       round(count(*) / (SELECT count(*) FROM o_survey_cohort), 3) AS percent_group
FROM o_survey_cohort GROUP BY age_group, is_female HAVING age_group IS NOT NULL""",
    "table1": """
SELECT age_group, count(*) AS n, count(*) / (SELECT count(*) FROM o_clean) AS percent_group
FROM o_clean GROUP BY age_group
UNION ALL SELECT 'sample size', count(*), CAST(NULL AS DOUBLE) FROM o_clean
UNION ALL SELECT '% female', CAST(sum(is_female) AS BIGINT), sum(is_female) / count(*) FROM o_clean""",
    "code_set": "SELECT * FROM o_cset_vafi",
    "code_set_own_lookback": "SELECT category, concept_id, score, 'vafi' AS fi, lookback FROM o_cset_vafi",
    "code_set_standard": "SELECT * FROM o_std_vafi",
    "code_set_by_id": """
SELECT DISTINCT concept_id, concept_name AS name FROM concept
WHERE standard_concept = 'S' AND concept_id IN (SELECT concept_id FROM o_cs_vafi)""",
    "ingredient_map": "SELECT * FROM o_ing",
    "exclusion_set": "SELECT * FROM o_excl",
    "source_code_set": "SELECT * FROM o_src_codes",
    "code_list_roundtrip": "SELECT concept_id, category, score FROM code_list",
    "hits_condition": f"SELECT {DOMAIN_COLS} FROM {search(V, 1, 1, 'condition')}",
    "hits_observation": f"SELECT {DOMAIN_COLS} FROM {search(V, 1, 1, 'observation')}",
    "hits_procedure": f"SELECT {DOMAIN_COLS} FROM {search(V, 1, 1, 'procedure')}",
    "hits_device": f"SELECT {DOMAIN_COLS} FROM {search(V, 1, 1, 'device')}",
    "hits_all": f"SELECT * FROM {hits_all(V, 1, 1)}",
    "hits_unique": f"SELECT * FROM {hits_unique(V, 1, 1)}",
    "hits_unique_1_3": f"SELECT * FROM {hits_unique(V, 1, 3)}",
    "hits_by_id_unique": f"""
SELECT DISTINCT h.person_id, h.age_group, h.is_female, h.person_start_date, h.person_end_date,
       c.category, c.score
FROM (SELECT * FROM {search(V, 1, 1)}
      WHERE concept_id IN (SELECT concept_id FROM concept WHERE standard_concept = 'S')) h
LEFT JOIN o_cs_vafi c ON h.concept_id = c.concept_id""",
    "deficits_1y": f"SELECT * FROM {deficits(V, 1, 1)}",
    "deficits_1y_seed7": f"SELECT * FROM {deficits(V, 1, 1, '_s7')}",
    "deficits_3y": f"SELECT * FROM {deficits(V, 3, 3)}",
    "source_code_hits": "SELECT * FROM o_src_def",
    "source_code_events": """
SELECT person_id, age_group, is_female, concept_id, concept_name, start_date, deficit,
       source_value, person_start_date, person_end_date, vocabulary_id FROM o_src_ev""",
    "probe_concept": """
SELECT person_id, age_group, is_female, concept_id, concept_name, start_date, deficit,
       source_value, person_start_date, person_end_date, vocabulary_id FROM o_src_ev
WHERE concept_id = 1
ORDER BY person_id, age_group, is_female, concept_id, concept_name, start_date, deficit,
         source_value, person_start_date, person_end_date, vocabulary_id
LIMIT 2""",
    "drug_era_rebuilt": "SELECT * FROM o_era",
    "drug_era": "SELECT * FROM o_win",
    "drug_era_window_start": "SELECT * FROM o_win_ws",
    "polypharmacy": f"SELECT * FROM {poly('o_win', 10)}",
    "polypharmacy_t5": f"SELECT * FROM {poly('o_win', 5)}",
    "polypharmacy_strict": f"SELECT * FROM {poly('o_win_strict', 5)}",
    "attrition_labels": """
SELECT 'claims' AS source, stage, label, format('{:,}', n) AS remaining,
       format('{:,}', lag(n) OVER (ORDER BY stage) - n) AS excluded,
       printf('%.1f%%', 100.0 * n / first_value(n) OVER (ORDER BY stage)) AS share
FROM o_attr""",
    "drug_era_built": "SELECT * FROM o_built",
    "polypharmacy_era_built": f"SELECT * FROM {poly('o_win_built', 5)}",
    "polypharmacy_era": f"SELECT * FROM {poly('o_win_era', 10, 'drug_concept_id')}",
    "poly_prevalence": f"""
SELECT score, is_female, age_group, n, total, n / total AS pct FROM (
  SELECT score, is_female, age_group, n,
         CAST(sum(n) OVER (PARTITION BY is_female, age_group) AS BIGINT) AS total
  FROM (SELECT CASE WHEN p.person_id IS NULL THEN 0 ELSE 1 END AS score, c.is_female,
               c.age_group, count(*) AS n
        FROM o_clean c LEFT JOIN (SELECT DISTINCT person_id FROM {poly('o_win', 5)}) p
          ON c.person_id = p.person_id
        GROUP BY 1, 2, 3) t) u
WHERE score = 1""",
    "poly_deciles": f"""
SELECT unnest([{PROBS}]) AS prob, unnest(quantile_cont(n, [{PROBS}])) AS value
FROM (SELECT CAST(coalesce(k.n, 0) AS DOUBLE) AS n FROM o_clean c
      LEFT JOIN o_icount k ON c.person_id = k.person_id) t""",
    "index_with_polypharmacy": "SELECT * FROM o_efi_poly",
    "index_with_polypharmacy_t5": "SELECT * FROM o_efi_poly_t5",
    "polypharmacy_survey": f"SELECT * FROM {poly('o_win_survey', 10, cohort_='o_survey_cohort')}",
    "score_bands": f"SELECT * FROM {SCORE_1}",
    "score_bands_fast": f"SELECT * FROM {SCORE_1}",
    "score_bands_left_closed": f"SELECT * FROM {SCORE_LC}",
    "band_summary_1y": "SELECT * FROM o_bands_1",
    "band_summary_3y": bands(SCORE_3),
    "band_summary_efi": bands(SCORE_EFI),
    "band_summary_efi_t5": bands(SCORE_EFI_T5),
    "band_summary_efi_3y": bands(SCORE_EFI_3),
    "band_summary_survey_1y": bands(SCORE_SURVEY[1]),
    "band_summary_survey_3y": bands(SCORE_SURVEY[3]),
    "score_bands_source": f"SELECT * FROM {SCORE_SRC}",
    "report_csv_roundtrip": "SELECT * FROM o_bands_1",
    "band_summary_suppressed": """
SELECT age_group, is_female, N,
       CASE WHEN n_prefrail < 20 THEN CAST(0 AS BIGINT) ELSE n_prefrail END AS n_prefrail,
       CASE WHEN n_frail < 20 THEN CAST(0 AS BIGINT) ELSE n_frail END AS n_frail,
       CASE WHEN n_robust < 20 THEN CAST(0 AS BIGINT) ELSE n_robust END AS n_robust,
       CASE WHEN n_prefrail < 20 THEN CAST(0 AS DOUBLE) ELSE prefrail END AS prefrail,
       CASE WHEN n_frail < 20 THEN CAST(0 AS DOUBLE) ELSE frail END AS frail,
       CASE WHEN n_robust < 20 THEN CAST(0 AS DOUBLE) ELSE robust END AS robust
FROM o_bands_1""",
    "category_summary": categories(deficits(V, 1, 1), "o_clean", unit=True, suppress=False),
    "category_summary_suppressed": categories(deficits(V, 1, 1), "o_clean", unit=True, suppress=True),
    "category_summary_3y": categories(deficits(V, 3, 3), "o_clean", unit=True, suppress=True),
    "category_summary_survey_1y": categories(SURVEY[1], "o_survey_cohort", unit=True, suppress=True),
    "category_summary_efi": categories("o_efi_poly", "o_clean", unit=False, suppress=True, flag=True),
    "category_summary_efi_t5": categories("o_efi_poly_t5", "o_clean", unit=False, suppress=True, flag=True),
    "category_summary_efi_3y": categories("o_efi_poly_3y", "o_clean", unit=False, suppress=True, flag=True),
    "report_set_pooled": " UNION ALL ".join([
        pooled_report(V, 1, "SELECT * FROM o_bands_1"), pooled_report(V, 3, bands(SCORE_3)),
        pooled_report(E, 1, bands(SCORE_EFI)), pooled_report(E, 3, bands(SCORE_EFI_3))]),
    "report_set_categories": " UNION ALL ".join([
        pooled_category_report(V, categories(deficits(V, 1, 1), "o_clean", unit=True, suppress=True)),
        pooled_category_report(E, categories("o_efi_poly", "o_clean", unit=False, suppress=True, flag=True))]),
    "band_summary_complementary": """
SELECT age_group, is_female, CASE WHEN NOT (small = 1 AND other IS NULL) THEN N END AS N,
       CASE WHEN NOT hp THEN n_prefrail END AS n_prefrail, CASE WHEN NOT hf THEN n_frail END AS n_frail,
       CASE WHEN NOT hr THEN n_robust END AS n_robust, CASE WHEN NOT hp THEN prefrail END AS prefrail,
       CASE WHEN NOT hf THEN frail END AS frail, CASE WHEN NOT hr THEN robust END AS robust
FROM (SELECT *,
             CASE WHEN small <> 1 THEN sp WHEN other IS NULL THEN true ELSE sp OR n_prefrail = other END AS hp,
             CASE WHEN small <> 1 THEN sf WHEN other IS NULL THEN true ELSE sf OR (n_frail = other AND n_prefrail <> other) END AS hf,
             CASE WHEN small <> 1 THEN sr WHEN other IS NULL THEN true
                  ELSE sr OR (n_robust = other AND n_prefrail <> other AND n_frail <> other) END AS hr
      FROM (SELECT *, CAST(sp AS INT) + CAST(sf AS INT) + CAST(sr AS INT) AS small,
                   list_min(list_filter([n_prefrail, n_frail, n_robust], lambda n: n >= 20)) AS other
            FROM (SELECT *, n_prefrail BETWEEN 1 AND 19 AS sp, n_frail BETWEEN 1 AND 19 AS sf,
                         n_robust BETWEEN 1 AND 19 AS sr FROM o_bands_1) a) b) c""",
    "method_icc_inference": f"""
SELECT n, CAST(2 AS BIGINT) AS k, round(f, 6) AS f_value,
       round(log10({ibeta('(n / (n + (n - 1) * f))', '(n / 2.0)', '((n - 1) / 2.0)')}), 6) AS log10_p,
       round((fl - 1) / (fl + 1), 6) AS icc_low, round((fu - 1) / (fu + 1), 6) AS icc_high
FROM (SELECT n, f, f / {fq('0.975', '(n - 1)', 'n')} AS fl, f * {fq('0.975', 'n', '(n - 1)')} AS fu
      FROM (SELECT CAST(n AS BIGINT) AS n, msb / msw AS f FROM o_icc) a) b""",
    "percent_category": f"""
SELECT age_group, is_female, category, coalesce(sum(score), CAST(0 AS DOUBLE)) AS n_yes,
       avg(score) AS prop_yes
FROM (SELECT person_id, age_group, is_female, score, category
      FROM (SELECT DISTINCT person_id, is_female, age_group, score, category
            FROM {deficits(V, 1, 1)}) d WHERE category = 'Multi'
      UNION ALL
      SELECT person_id, age_group, is_female, CAST(0 AS DOUBLE), 'Multi' FROM o_clean c
      WHERE NOT EXISTS (SELECT 1 FROM {deficits(V, 1, 1)} h
                        WHERE h.person_id = c.person_id AND h.category = 'Multi')) u
GROUP BY age_group, is_female, category""",
    "band_check": """
SELECT *, prefrail + frail + robust AS fraction_sum, (n_prefrail + n_frail + n_robust) / N AS count_share
FROM o_bands_1""",
    "band_long": """
SELECT age_group, is_female, 'prefrail' AS name, prefrail AS value FROM o_bands_1
UNION ALL SELECT age_group, is_female, 'frail', frail FROM o_bands_1
UNION ALL SELECT age_group, is_female, 'robust', robust FROM o_bands_1""",
    "posthoc_categories": f"""
SELECT DISTINCT h.person_id, h.age_group, h.is_female, h.person_start_date, h.person_end_date,
       c.category, c.score
FROM {search(V, 1, 1)} h LEFT JOIN code_list c ON h.concept_id = c.concept_id
WHERE h.age_group IS NOT NULL""",
    "method_totals": "SELECT * FROM o_tot",
    "method_prevalence": """
SELECT category, sum_score_x / (SELECT count(*) FROM o_clean) AS prev_x,
       sum_score_y / (SELECT count(*) FROM o_clean) AS prev_y FROM o_tot""",
    "method_icc": """
SELECT n, CAST(2 AS BIGINT) AS k, n - 1 AS df1, n AS df2, round(msb, 4) AS msb, round(msw, 4) AS msw,
       round((msb - msw) / (msb + msw), 6) AS icc, round(msb / msw, 6) AS f_value FROM o_icc""",
    "method_icc_without": """
SELECT n, CAST(2 AS BIGINT) AS k, n - 1 AS df1, n AS df2, round(msb, 4) AS msb, round(msw, 4) AS msw,
       round((msb - msw) / (msb + msw), 6) AS icc, round(msb / msw, 6) AS f_value FROM o_icc_without""",
    "method_corr": """
SELECT 'all' AS subset, count(*) AS n, round(corr(sum_score_x, sum_score_y), 6) AS corr
FROM o_tot WHERE sum_score_x IS NOT NULL AND sum_score_y IS NOT NULL
UNION ALL
SELECT 'without Brand#1', count(*), round(corr(sum_score_x, sum_score_y), 6)
FROM o_tot WHERE sum_score_x IS NOT NULL AND sum_score_y IS NOT NULL AND category <> 'Brand#1'""",
}

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _deps(text: str) -> set[str]:
    return {w for w in _WORD.findall(text) if w in CTES}


def render(final: str) -> str:
    """``WITH`` + every view ``final`` needs (transitively, in definition order)."""
    need: set[str] = set()
    todo = list(_deps(final))
    while todo:
        n = todo.pop()
        if n in need:
            continue
        need.add(n)
        todo.extend(_deps(CTES[n]) - need)
    ordered = [n for n in CTES if n in need]
    if not ordered:
        return final.strip()
    body = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in ordered)
    return f"WITH {body}\n{final.strip()}"


def oracle_sql() -> dict[str, str]:
    return {name: render(q) for name, q in QUERIES.items()}
