"""Composite jobs and the registered driver queries."""
