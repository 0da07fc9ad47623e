"""Continuous ingest of a growing corpus."""
