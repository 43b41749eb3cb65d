"""Metrics of predictions that keep arriving."""
