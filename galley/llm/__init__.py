"""Training-data operators: language id, decontamination, deduplication, packing, quality, counts and sharding."""
