"""Logical plans: the enrichment pipeline and the report frames."""
