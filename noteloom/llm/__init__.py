"""Training-data operators: near-duplicates, filters, extraction, tokenizing, scoring, mixing and media.

Nothing outside this package imports it; ``llm.queries`` holds its registered queries.
"""
