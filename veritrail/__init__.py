"""Veritrail: academic-integrity analytics as PySpark DataFrame jobs."""
