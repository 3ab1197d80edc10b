"""Scalar functions and the keyword table function."""
