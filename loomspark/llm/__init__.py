"""Operators for preparing large text corpora: dedup, fingerprints, quality, packing.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
