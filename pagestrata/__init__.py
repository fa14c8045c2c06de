"""Spark-native page inventory, evidence and update-priority engine.

Every operator is a ``DataFrame -> DataFrame`` transform or a function that
returns a ``Column``; several sites can be processed in one job because every
per-site rule is keyed by the ``site`` (host) column.
"""

__version__ = "0.1.0"
