"""Training-data operators: deduplication, scanning, scoring, packing and archiving of text corpora.

Nothing else in the library imports this subpackage.
"""
