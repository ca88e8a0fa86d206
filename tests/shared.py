"""Paths and helpers of the tests (import from here, never from ``conftest``:
every folder has one, and only one of them can be the module of that name)."""

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
