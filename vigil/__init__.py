"""vigil: Spark-native operators for risk scoring and model monitoring.

Every operator takes and returns DataFrames and is generic in column names.
Sub-packages:

- ``sources``    scans, contracts on input, sinks
- ``functions``  pure Column -> Column expressions (cleaning, decisions)
- ``operators``  table operators (temporal, curves, metrics, drift, facets, ML)
- ``plans``      bindings to the test tables and the registered query keys
- ``streaming``  Structured Streaming twins of the batch monitors
"""

from vigil.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
