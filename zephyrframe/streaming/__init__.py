"""Structured Streaming forms of the hourly job."""
