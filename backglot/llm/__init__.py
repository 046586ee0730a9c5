"""Training-data operators: deduplication, tokenizing, scoring, decontamination, search, formatting."""
