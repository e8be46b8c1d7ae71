"""The same plans over Structured Streaming."""
