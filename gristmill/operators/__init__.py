"""Relational, profiling, graph and text operators."""
