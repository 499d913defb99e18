"""The change feed in Structured Streaming."""
