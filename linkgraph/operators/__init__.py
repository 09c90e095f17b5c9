"""Operators on DataFrames: ranking and acceptance, soft sets, graphs, rounds."""
