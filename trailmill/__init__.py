"""Fitness-activity analytics as Spark DataFrame operators."""
