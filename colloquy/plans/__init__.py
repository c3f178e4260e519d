"""Composite jobs and the query registry."""
