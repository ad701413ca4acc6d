"""Operators for large text corpora: joins, mixing, dedup, scans, tokens, language, vectors, sketches, quality."""
