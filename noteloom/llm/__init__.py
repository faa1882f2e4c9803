"""Training-data operators: scoring, deduplication, filtering, scanning and packing of text corpora."""
