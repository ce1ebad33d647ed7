"""Structured Streaming jobs over the signal log, each with a batch twin."""
