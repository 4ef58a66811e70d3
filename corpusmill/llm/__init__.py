"""Training-data operators: dedup, formatting, scanning, scoring, packing.

Nothing outside this subpackage imports it.
"""
