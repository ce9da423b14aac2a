"""Ordered chains of operators."""
