"""Training-data operators: language-model scoring, deduplication, scans, tokenising.

Nothing outside this subpackage imports it.
"""
