"""Scalar functions as Column expressions, with plain Python twins where a driver needs them."""
