"""sftlens: Spark-native preparation and analysis of SFT data and model evaluation output.

Every public function takes and returns a ``DataFrame`` (operators) or a
``Column`` (functions); nothing holds a global session.  Sub-packages:

* ``sources``   – JSONL / manifest / telemetry scans and the driver tables
* ``functions`` – Column expressions (text, VARIANT extraction, maths normaliser)
* ``operators`` – DataFrame -> DataFrame building blocks (prepare, encode, export,
  validate, stats, grading, compare)
* ``sinks``     – JSONL writer, validated publish, comparison writer
* ``plans``     – the registered queries over the driver tables, with SQL oracles
* ``streaming`` – incremental ingest and rolling telemetry
"""

__version__ = "0.1.0"
