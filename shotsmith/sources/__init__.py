"""Readers and writers: labelled tables, rankings, results."""
