"""Training-data operators: packing, scoring, deduplication, extraction, search, archives and mixing."""
