"""Screening-trajectory analytics as Spark DataFrame jobs."""
