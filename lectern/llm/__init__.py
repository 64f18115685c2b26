"""Training-data operators: scoring, deduplication, search, extraction, formatting and tokenizing."""
