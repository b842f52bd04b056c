"""Scalar functions and answer metrics."""
