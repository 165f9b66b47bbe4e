"""Spark analytics for vulnerability-fix code pairs."""
