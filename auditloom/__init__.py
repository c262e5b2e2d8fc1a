"""Part of the PySpark site-audit engine."""
