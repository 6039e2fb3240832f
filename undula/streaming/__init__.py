"""Signals as streams."""
