"""cohortlens: Spark-native longitudinal cohort and multimodal risk analytics.

Every public function takes and returns Spark DataFrames (or Columns) and is
composable with ``DataFrame.transform``.  Packages:

* ``sources``   - readers, sinks and the test-data adapters
* ``functions`` - Column-level helpers (dates, hashing, text, vector math)
* ``operators`` - DataFrame -> DataFrame operators (cohort, split, impute,
                  sequences, vectors, metrics, bootstrap, classifiers)
* ``plans``     - end-to-end jobs and the registered query catalog
"""

from cohortlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
