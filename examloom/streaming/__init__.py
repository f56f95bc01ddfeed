"""Structured Streaming forms of the telemetry operators."""
