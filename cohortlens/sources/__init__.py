"""Readers, sinks and the driver test-table adapters."""
