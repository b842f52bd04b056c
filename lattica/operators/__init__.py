"""Relational, graph and report operators."""
