"""Training-data operators: filtering, deduplication, redaction, scoring and packing of text at scale.

Nothing else in the library imports this subpackage.
"""
