"""Scores, normalises and ranks places from open-data tables, as Spark jobs."""
