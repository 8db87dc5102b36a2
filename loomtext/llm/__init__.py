"""Training-data operators: archives, deduplication, filters, mixing, token files."""
