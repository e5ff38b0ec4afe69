"""Queries over the driver's tables, and the same questions in SQL for an independent engine."""
