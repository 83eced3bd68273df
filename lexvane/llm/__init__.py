"""Operators of a training-data pipeline: scoring, deduplication, mixing, sharding, packing and encoding of corpora.

Nothing outside this subpackage imports it; removing the folder leaves the rest of the library whole.
"""
