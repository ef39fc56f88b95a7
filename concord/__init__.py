"""concord - table reconciliation and data-quality checks on Spark.

Layout:
  functions/  Column expressions: canonical text, hashing, DQ rules, mapping transforms
  operators/  DataFrame -> DataFrame operators: diffs, checksums, checks, lookups, profiling
  sources/    file and JDBC readers, SQL helpers
  plans/      mapping documents, suite runner, run reports, the test-table scenarios
  streaming/  (none: the reconciled engine has no streaming operators)
"""

__version__ = "0.1.0"
