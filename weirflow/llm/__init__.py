"""Training-data operators: packing, scoring, scanning, sharding, deduplication, token files."""
