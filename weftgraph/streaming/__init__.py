"""Traversals over edges that arrive as a stream."""
