"""Sequence-graph analytics on Spark."""
