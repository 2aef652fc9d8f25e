"""Whole jobs, the registered queries, and their SQL twins."""
