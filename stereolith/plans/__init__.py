"""Whole pipelines over the engine's tables."""
