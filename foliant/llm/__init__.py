"""Operators for large training-data pipelines: dedup, media, HTML, sharding, PII, language, chat and tokenizing."""
