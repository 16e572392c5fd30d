"""Training-data operators: scoring, tokenizing, deduplicating and filtering text corpora.

Every module holds one operator with its own general interface and the thin
``opN_<name>`` query that applies it to the driver's tables.
"""
