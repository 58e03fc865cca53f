"""Training-data operators: quality, toxicity, secrets, licences, duplicates, tokens."""
