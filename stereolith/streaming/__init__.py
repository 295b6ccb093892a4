"""Structured Streaming. An extension: the engine's data has no streams of its own."""
