"""Predicates and scalar functions."""
