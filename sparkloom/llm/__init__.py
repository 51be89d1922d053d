"""Training-data operators: deduplication, search, mixing, extraction, sharding, language ID, BPE, LM scoring."""
