"""Scans, feeds and sinks."""
