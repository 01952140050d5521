"""Training-data operators: packing, language ID, extraction, deduplication, search, filtering."""
