"""Training-data operators: search, cleaning, deduplication, formatting, scoring and mixing of text corpora."""
