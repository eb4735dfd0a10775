"""Structured Streaming over the same stateless operators (an extension)."""
