"""Streaming entry points (scoring a stream with a fitted pipeline)."""
