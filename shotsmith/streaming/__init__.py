"""Micro-batch retrieval for query files that keep arriving.

The original pipeline has no streams; this package only lets the batch
retrieval serve a growing query folder.  See ``retrieval``.
"""
