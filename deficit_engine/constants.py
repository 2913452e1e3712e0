"""Fixed values that results depend on.

These must equal the study definitions for results to be comparable, so they
are stated once, here, as plain values.
"""

# --- fixed values -----------------------------------------------------------
MALE_CONCEPT_ID = 8507              # gender_concept_id coded as male
MALE_TEXT = "Male"                  # sex_at_birth text coded as male
IMPUTE_BIRTH_YEAR_BEFORE = 1938     # birth years before this are imputed
IMPUTED_AGE = 84                    # age given to imputed birth years
MIN_AGE = 40
MIN_HISTORY_DAYS = 365
AGE_BREAKS_CLAIMS = (40, 45, 50, 55, 60, 65, 70, 75, 80, 100)
AGE_BREAKS_RESEARCH = (40, 45, 50, 55, 60, 65, 70, 75, 80, 120)
BASICS_SURVEY = "The Basics"
CHRONIC_LOOKBACK_CODE = 3           # lookback value marking a chronic category
ANTIBIOTIC_ANCESTOR_ID = 21602796   # ancestor concept of excluded ingredients
EXCLUSION_AS_OF = "2024-07-15"      # validity date for the exclusion set
POLYPHARMACY_THRESHOLD = 10
PERSISTENCE_DAYS = 30               # longest gap inside a drug era
POLYPHARMACY_CATEGORY = "Polypharmacy"
SUPPRESS_BELOW = 20                 # small-cell suppression threshold
VAFI = {"denominator": 31, "lb": 0.10, "ub": 0.20}
EFI = {"denominator": 36, "lb": 0.12, "ub": 0.24}
VAFI_OLD = {"denominator": 31, "lb": 0.11, "ub": 0.21}
DECILE_PROBS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
INDEX_NAMES = ("efi", "efragicap", "hfrs", "vafi", "efi2", "efi_sno_expanded")
# ---------------------------------------------------------------------------
