"""Operators of a training-data pipeline: packing, search, archives, scoring, language, segmentation, extraction, near copies, secrets.

Nothing else in the library imports this subpackage.
"""
