"""Readers and writers: N-Triples, line documents, exchange records."""
