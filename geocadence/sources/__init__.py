"""Readers, sinks and bindings of tables."""
