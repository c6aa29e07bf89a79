"""Incremental forms of the engine on Structured Streaming."""
