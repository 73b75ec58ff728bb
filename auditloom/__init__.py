"""Auditloom: audit analytics over multi-agent traffic, expressed on Spark DataFrames."""

__version__ = "0.1.0"
