"""Cohort-scale scan analytics as Spark DataFrame operators."""
