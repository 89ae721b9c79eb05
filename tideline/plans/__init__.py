"""Descriptions of table groups: which tables belong together and how."""
