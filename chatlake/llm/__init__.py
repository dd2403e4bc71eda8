"""Training-data operators: archives, media, deduplication, classification, tokens and packing."""
