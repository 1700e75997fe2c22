"""Spark jobs for benchmark curation, grading, paired statistics and study notes."""
