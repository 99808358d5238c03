"""Readers, table adapters and sinks."""
