"""Signals from and to files."""
