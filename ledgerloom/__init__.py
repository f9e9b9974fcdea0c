"""Table consolidation and reconciliation as PySpark DataFrame jobs."""

__version__ = "0.1.0"
