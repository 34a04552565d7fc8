"""Operators over domain tables."""
