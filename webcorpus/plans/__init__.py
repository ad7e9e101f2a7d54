"""Queries composed from the operators."""
