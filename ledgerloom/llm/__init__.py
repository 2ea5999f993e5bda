"""Training-data operators: deduplication, scoring, mixing, tokenised output and packing."""
