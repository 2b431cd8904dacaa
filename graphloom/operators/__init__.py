"""Relational, vector, graph and resolution operators over DataFrames."""
