"""Scalar functions over text columns."""
