"""Compositions: retrieval, profiles, training and maintenance."""
