"""Lodestar Market: equity-market analytics as plain PySpark jobs."""
