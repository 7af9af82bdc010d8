"""Scans, adapter views over the driver tables, sinks and the upsert writer."""
