"""Training-data operators: dedup, sharding, search, archives, extraction, mixing, tokenising, quality."""
