"""wardsift: report-triage analytics on Spark.

Every public function takes DataFrames (plus plain parameters) and returns DataFrames or
column expressions.  ``functions`` holds expressions, ``operators`` holds DataFrame operators,
``sources`` reads and writes tables, ``plans`` strings operators into whole runs, and
``streaming`` feeds the same operators from a file stream.
"""

__version__ = "0.1.0"
