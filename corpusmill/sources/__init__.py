"""Corpus descriptions, scans, caches and sinks."""
