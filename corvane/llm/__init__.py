"""Training-data operators: sharding, tokenising, filtering, deduplication and media columns."""
