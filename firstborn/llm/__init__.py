"""Training-data operators: mixing, duplicates, quality, tokens."""
