"""Training-data operators: deduplication, search, mixing, packing, filters and scoring."""
