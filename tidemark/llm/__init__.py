"""Training-data operators: deduplication, decontamination, filtering, tokens and shards."""
