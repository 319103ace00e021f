"""Landed files, the stored table, and the test-table adapter."""
