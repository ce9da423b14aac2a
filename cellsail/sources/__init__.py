"""Readers of expression data."""
