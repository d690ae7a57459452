"""Readers, projections of the driver tables, sinks."""
