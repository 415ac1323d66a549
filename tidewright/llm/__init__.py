"""Training-data operators: extraction, privacy, quality, deduplication, mixing and tokenization."""
