"""Operators over triples, hierarchies, events, graphs and provenance: DataFrames in, DataFrames out."""
