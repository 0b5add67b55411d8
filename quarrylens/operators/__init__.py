"""Relational, graph, similarity and rule operators over DataFrames."""
