"""Training-data operators: tokenising, deduplication, filtering, packing and formatting."""
