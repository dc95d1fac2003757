"""Training-data operators: licence scan, toxicity, archives, mixing, tokenising, near-duplicates, search, URL filter, encoding, packing, infilling."""
