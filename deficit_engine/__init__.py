"""Deficit-accumulation index analytics on Spark.

Every public function takes and returns DataFrames; nothing is collected in
library code except bounded metadata (a category list, a pair of date bounds,
a capped hot-key list). Sub-packages:

* ``sources``   - input tables (OMOP projections of the driver tables, code
                  lists), readers, writers and materialisation points
* ``functions`` - column-expression helpers (dates, banding, two-arm if)
* ``operators`` - cohort, code sets, event search, polypharmacy, scoring,
                  reporting, agreement, skew handling
* ``plans``     - end-to-end runs and the query registry used by
                  ``__spark_entry__``
"""

from deficit_engine.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
