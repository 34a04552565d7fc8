"""Structured Streaming forms of the archive, roses, daily areas, sessions and incremental extraction."""
