"""Relational, graph, retrieval and statistics operators on DataFrames."""
