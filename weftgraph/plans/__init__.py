"""Traversals and their lowering to DataFrames."""
