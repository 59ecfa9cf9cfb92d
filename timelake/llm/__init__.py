"""Training-data operators: extraction, tokenising, archives, filtering, deduplication, search and mixing."""
