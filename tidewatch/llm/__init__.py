"""Training-data operators: tokenising, media, mixing, search, extraction, dedup, scoring, PII, WARC.

Nothing outside this package imports it; ``queries`` holds the registered
queries and their SQL.
"""
