"""Operators for preparing training text: deduplication, filtering, scanning, sharding, packing and coding."""
