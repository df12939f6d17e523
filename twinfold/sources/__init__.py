"""Readers, parsers of stored replies and create-new sinks."""
