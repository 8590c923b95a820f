"""Quillon: a Spark-first analytics engine for application-security findings."""
