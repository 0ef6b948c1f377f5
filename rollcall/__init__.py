"""Governance analytics as PySpark DataFrame jobs."""
