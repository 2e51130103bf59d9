"""Corpus preparation: URL filters, license scans, near-duplicates, tokens, mixing, quality and language."""
