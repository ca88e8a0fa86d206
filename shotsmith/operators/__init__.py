"""Retrieval, selection, prompt, scoring and decoding operators."""
