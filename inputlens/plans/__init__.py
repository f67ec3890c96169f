"""Whole jobs: the batch run, the read queries and the registered driver queries."""
