"""Column-expression helpers (all JVM-side, codegen friendly)."""

from deficit_engine.functions.dates import add_years, completed_years, to_date
from deficit_engine.functions.expr import (
    age_band, age_band_lower, band_flags, flag_unless_equal, if_else, percent_label,
    thousands_label)
from deficit_engine.functions.special import f_quantile, f_upper_tail, incomplete_beta, log_gamma

__all__ = ["add_years", "completed_years", "to_date", "age_band", "age_band_lower",
           "band_flags", "flag_unless_equal", "if_else", "percent_label", "thousands_label",
           "log_gamma", "incomplete_beta", "f_upper_tail", "f_quantile"]
