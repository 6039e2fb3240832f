"""Chains of operators: parsing, resolution and rewriting."""
