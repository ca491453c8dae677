"""Operators for preparing training text: scans, tokens, toxicity, shards, leaks, extraction, duplicates, archives."""
