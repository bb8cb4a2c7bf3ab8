"""Scalar functions as native Column expressions (no Python on the row path)."""
