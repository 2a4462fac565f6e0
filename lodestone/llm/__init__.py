"""Training-data operators: scoring, extraction, near-duplicate joins, tokenisation."""
