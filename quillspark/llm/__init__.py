"""Training-data operators: packing, PII, language, contamination, duplicates, chat, quality, archives, toxicity, tokens."""
