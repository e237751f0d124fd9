"""Training-data operators: dedup, filtering, scoring, mixing, packing, search and media columns."""
