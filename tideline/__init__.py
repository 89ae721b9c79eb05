"""Tideline: data retention, archive verification and table-health analytics on PySpark."""

__version__ = "0.1.0"
