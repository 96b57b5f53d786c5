"""Structured Streaming jobs and their idempotent sinks."""
