"""Vendor feeds, catalogue scans and catalogue sinks."""
