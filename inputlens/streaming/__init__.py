"""The speed layer as Structured Streaming queries."""
