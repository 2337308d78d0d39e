"""Training-data operators: archives, extraction, deduplication, tokens and language.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
