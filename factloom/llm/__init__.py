"""Training-data operators: extraction, deduplication, scoring, packing and sharding."""
