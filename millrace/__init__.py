"""Spark-first analytics over entity, season and event tables."""
