"""Operators on expression frames."""
