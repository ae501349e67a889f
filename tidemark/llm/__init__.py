"""Operators that prepare training corpora: formatting, deduplication, filtering, packing and sharding."""
