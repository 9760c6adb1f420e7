"""riskframe — tabular risk analytics as lazy Spark DataFrame plans.

Subpackages:
  sources    readers, writers, file inventory, derived test fixtures
  functions  column-expression helpers (p-values, HMAC, regex, bands)
  operators  the analytics operators (profile, clean, stats, metrics, text, ...)
  plans      the registered queries and their DuckDB oracle SQL
  streaming  Structured Streaming forms of alerting, scoring and the ledger
"""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Executors need no copy of this package: functions that run inside tasks
# travel by value with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
