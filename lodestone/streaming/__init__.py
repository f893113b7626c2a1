"""Structured Streaming forms of the event log jobs."""
